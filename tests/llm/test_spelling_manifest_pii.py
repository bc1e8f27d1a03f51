"""Spelling variants, manifest and personal data against their SQL and against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm import manifest, oracles, personal_data, registry, spelling
from tablewright.llm.shared import fold as lowered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return text.translate(str.maketrans(spelling.UPPER, spelling.LOWER))


def held(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def by_sql(spark, docs, sql, folder, columns):
    docs.write.parquet(f"{folder}/documents.parquet")
    with duckdb.connect() as store:
        store.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        return held(store.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def table(spark, rows, parts=5):
    """With columns that clash with names that operators use."""
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit("x") for c in ("word", "rank", "key", "leaf", "claimed", "place", "spans", "group")})


AWKWARD = [
    (1, "Meadow meadow meadow. meadov meadov meadov medow medow medow medows", "en", "a", 1), (1, "Meadow meadow meadow. meadov meadov meadov medow medow medow medows", "en", "a", 1),
    (None, None, None, None, None), (None, "", "de", None, 0), (2, None, None, "b", None), (3, "", None, "", 3), (4, "ÉÈÀàà éèàaa aaaaa AAAAA aaaaa aaaab aaaab aaaab", None, "a", 2),
    (5, "x" * 30_000 + " mail bob.1@a-b.example.org", "xx", "ä", 7), (6, "iban GB82 WEST 1234 5698 7654 32 and +1 (988) 555-2485, 1.2.3.4.5.6.7.8", "en", "a", 9),
]


# --- 11


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_variants(rows):
    counts = Counter()
    for number, text, *_ in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            k = h % len(run)
            word = run[:k] + run[k + 1 :] if h % 97 == 0 else run
            if len(word) >= 5:
                counts[word] += 1
    known = {w: n for w, n in counts.items() if n >= 3}
    form, others = {}, {}
    for w, n in known.items():
        beside = sorted((-m, x) for x, m in known.items() if near(w, x))
        others[w] = len(beside)
        form[w] = beside[0][1] if beside and -beside[0][0] >= 2 * n else None
    found = []
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n, others[w], known.get(form[w])))
    return held(found)


VARIANT_COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def spelt(lengths, count, seed):
    """Words of few letters with errors, so that many are near to each other."""
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abé") for _ in range(n)) for n in lengths]
    rows = []
    for i in range(count):
        word = draw.choice(pool)
        for _ in range(draw.randint(0, 2)):
            k = draw.randrange(len(word))
            word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("abéÉ") + word[k + 1 :], word[:k] + draw.choice("abé") + word[k:]])
        if i % 7 == 0:
            pool.append(word)
        rows.append((draw.choice([None, i]), " ".join([word] * draw.randint(1, 9)), None, "s", 1))
    return rows


@pytest.mark.parametrize("rows", [spelt((5, 6, 7, 8), 300, 1), spelt((62, 63, 64, 65, 66, 67, 300), 200, 2), AWKWARD * 2], ids=["short", "long", "awkward"])
def test_spelling_variants(spark, tmp_path, rows):
    docs = table(spark, rows)
    found = held(spelling.spelling_variants(docs).select(VARIANT_COLUMNS).collect())
    assert found == plain_variants(rows)
    assert found == by_sql(spark, docs, oracles.OP11, tmp_path, VARIANT_COLUMNS)


def test_spelling_ties_and_chains(spark):
    counts = {"meadow": 3, "meadov": 6, "meadoy": 6, "neadov": 12, "neadot": 24, "meadows": 6, "zzzzzz": 3, "zzzzz": 2}
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string")
    rows = {r.word: r for r in spelling.variants(spelling.vocabulary_of(words)).collect()}
    assert (rows["meadow"].form, rows["meadow"].n_near, rows["meadow"].root) == ("meadov", 3, "neadot")  # of equal counts the smallest
    assert (rows["meadov"].form, rows["neadov"].form, rows["neadot"].form) == ("neadov", "neadot", None)
    assert (rows["zzzzzz"].form, rows["zzzzzz"].n_near, rows["zzzzzz"].root) == (None, 0, "zzzzzz") and "zzzzz" not in rows


def test_spelling_hot_word_and_empty(spark):
    hot = spark.createDataFrame([(i, "common commom common" if i % 3 else "other", None, "s", 1) for i in range(3000)], SCHEMA)
    rows = {r.word: (r.n, r.form) for r in spelling.spelling_variants(hot, every=1 << 40).collect()}
    assert rows == {"common": (4000, None), "commom": (2000, "common"), "other": (1000, None)}
    assert spelling.spelling_variants(hot.limit(0)).collect() == []


def test_long_groups_are_those_of_the_letters():
    """Hashed groups of long words agree exactly where the spelt-out ones do."""
    draw = random.Random(5)
    words = ["".join(draw.choice("ab") for _ in range(draw.randint(5, 8))) for _ in range(60)]
    hashed, plain = {}, {}
    for w in set(words):
        spelt_out = {spelling.OWN: [(w,)], spelling.OPENED: [(w[:i] + "*" + w[i + 1 :],) for i in range(len(w))], spelling.SHORTER: sorted({(w[:i] + w[i + 1 :],) for i in range(len(w))})}
        for kind, keys in spelling.long_groups(w):
            for key in keys:
                hashed.setdefault(key.tobytes(), set()).add((kind, w))
            for key in spelt_out[kind]:
                plain.setdefault(key, set()).add((kind, w))
    assert sorted(map(sorted, hashed.values())) == sorted(map(sorted, plain.values()))


# --- 12


def plain_leaf(row, fold_text):
    number, text, lang, source, n_chars = row
    fields = [number, source, lang, n_chars, lower(text) if fold_text and text is not None else text]
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes):
    """Root and, of each node, what stands before and after it on each level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, (i, k) in zip(paths, enumerate(places)):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            path.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            places[i] = k // 16
        nodes = [digest("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_manifest(rows):
    leaves = [(r[3], r[0], plain_leaf(r, False), plain_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)) for r in rows]
    leaves.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups = [list(g) for _, g in groupby(leaves, key=lambda r: r[0])]
    trees = [plain_tree([r[2] for r in g]) for g in groups]
    root, ups = plain_tree([t[0] for t in trees]) if trees else (None, [])
    found = []
    for group, (subroot, paths), up in zip(groups, trees, ups):
        for (_, number, leaf, claimed), path in zip(group, paths):
            folded = manifest.fold(claimed, path + up)
            found.append((number, leaf, subroot, root, digest("".join(a + b for a, b in path + up)), folded, folded == root))
    return held(found)


MANIFEST_COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def made_up(count, sources, seed):
    draw = random.Random(seed)
    one = lambda: (draw.choice([None, draw.randrange(count), draw.randrange(count)]), draw.choice([None, "", "Abc É", "xyz"]), draw.choice([None, "en"]), draw.choice(sources), draw.choice([None, 7]))
    rows = [one() for _ in range(count)]
    return rows + rows[: count // 10]


@pytest.mark.parametrize(
    "rows",
    [[], made_up(1, ["a"], 1), made_up(16, [None], 2), made_up(17, ["a"], 3), made_up(900, ["hot"] * 9 + [None, "ü", "z"], 4), made_up(600, [str(k) for k in range(300)], 5), made_up(4300, ["a"], 6), AWKWARD],
    ids=["empty", "one", "run", "run and one", "hot source", "many sources", "four levels", "awkward"],
)
def test_manifest(spark, tmp_path, rows):
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    found = held(registry.op12_merkle_manifest(spark, f"{tmp_path}/sf").select(MANIFEST_COLUMNS).collect())
    assert found == plain_manifest(rows)
    assert found == by_sql(spark, docs, oracles.op12(), tmp_path, MANIFEST_COLUMNS)


def test_manifest_gives_proofs_that_fold(spark):
    docs = table(spark, made_up(500, ["a", "a", "a", "b", None], 7), parts=9)
    leaves = manifest.leaf_table(docs, "source", "doc_id", manifest.leaf_digest(docs["doc_id"], docs["text"]))
    rows = manifest.manifest(leaves, siblings=True).collect()
    assert len(rows) == 550
    for r in rows:
        path = [(s.before, s.after) for s in r.path]
        assert manifest.fold(r.leaf, path) == r.root and r.verified and digest("".join(a + b for a, b in path)) == r.proof_sha256
        assert manifest.fold(digest("other"), path) != r.root


@pytest.mark.parametrize("size", [1, 15, 16, 17, 255, 256, 257, 700])
@pytest.mark.parametrize("cuts", [[], [1], [16, 32], [5, 250, 251], list(range(0, 700, 13))])
def test_parts_of_a_tree_meet_at_their_edges(size, cuts):
    """Wherever a level is cut, the parts' whole nodes and what they hand on at their edges make up the tree."""
    nodes = [digest(str(k)) for k in range(size)]
    bounds = sorted({0, size, *[c for c in cuts if c < size]})
    parts = [manifest.Part(0, s, nodes[s:e], size) for s, e in zip(bounds, bounds[1:])]
    handed = {(level, place): node for p in parts for level, place, _, node in p.edges()}
    wanted = {(level, run) for p, (s, e) in zip(parts, zip(bounds, bounds[1:])) for level, run in p.wants(s, e - 1)}
    level, tree = 0, {0: nodes}
    while len(tree[level]) > 1:
        tree[level + 1] = [digest("".join(tree[level][k : k + 16])) for k in range(0, len(tree[level]), 16)]
        level += 1
    for (at, place), node in handed.items():
        assert tree[at][place] == node
    for at in range(level):
        for run in range(len(tree[at + 1])):
            whole = [p.run(at, run) for p in parts if p.run(at, run)]
            assert whole in ([], [tree[at][run * 16 : run * 16 + 16]])
            if not whole:  # then all its nodes are handed on, or made of such
                assert all((at, k) in handed or (at - 1, k) in wanted for k in range(run * 16, min(run * 16 + 16, len(tree[at])))) and (at, run) in wanted
    assert all(len(p.levels) < 10 and sum(1 for _ in p.edges()) <= 32 * len(p.levels) for p in parts)


# --- 13


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(found))


def listed(text, kinds=personal_data.KINDS):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in personal_data.find_spans(text) if s.kind in kinds)


def noise(seed, count):
    draw = random.Random(seed)
    bits = ["1", "23", "456", "4111", "000", ".", ".", "-", " ", " ", "@", "a", "bé", "%", "+", "(", ")", "\n", "tel ", "GB82", "WEST", "1234 5698 7654 32", "order ", "988-555-2485", "123-45-6789", "ssn: ", "4539148803436467"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 24))) for _ in range(count)]


def test_base_spans_are_those_of_the_patterns():
    for text in noise(1, 20_000):
        assert listed(text, personal_data.BASE_KINDS) == plain_base(text)


PII_COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "best_score"]


def test_personal_data(spark, tmp_path):
    texts = [None, "", *noise(2, 800), "a" * 100_000, "1" * 50_000, "1." * 20_000, "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "call 988-555-2485", "order 988-555-2485", "ssn 666-45-6789, ssn 123-45-6789"]
    rows = [(None if k % 50 == 7 else k // 2, t, None, "s", 1) for k, t in enumerate(texts)]
    docs = table(spark, rows)
    found = held(personal_data.personal_data(docs).select(PII_COLUMNS).collect())
    assert Counter((r[0], r[5], r[6]) for r in found) == Counter((r[0], digest(plain_base(r[1] or "")), listed(r[1] or "")) for r in rows)
    assert found == by_sql(spark, docs, oracles.op13(), tmp_path, PII_COLUMNS)
    assert personal_data.personal_data(docs.limit(0)).collect() == []


def test_checksums_confirm_and_words_decide():
    assert listed("DE89 3704 0044 0532 0130 00 GB82WEST12345698765432", ["iban"]) == "iban:0:27,iban:28:50"
    assert listed("DE88 3704 0044 0532 0130 00 GB82WEST12345698765433", ["iban"]) == ""
    assert listed("988-555-2485") == "" and listed("Phone: 988-555-2485") == "local_phone:7:19" and listed("phone for invoice 988-555-2485") == ""
    assert listed("123-45-6789") == "" and listed("SSN 123-45-6789") == "ssn:4:15" and listed("SSN 000-45-6789") == ""
    assert [s.score for s in personal_data.find_spans("card 4539148803436467, and far from that word order 4539148803436467")] == [100, 60]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 200_000, "a" * 1_000_000, "a@" * 100_000, "+1" + " " * 1_000_000, "AB12 " * 50_000, "@" * 200_000, "1-" * 200_000])
def test_hostile_texts_take_linear_time(text):
    personal_data.find_spans(text)


def test_redaction(spark):
    docs = table(spark, [(1, "mail a.b@c.de now", None, None, None), (2, None, None, None, None), (3, "none", None, None, None), (4, "+1 (988) 555-2485", None, None, None)])
    rows = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert rows == {1: "mail [email] now", 2: None, 3: "none", 4: "[phone]"}
    assert personal_data.redact(docs).columns == docs.columns

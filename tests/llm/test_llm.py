"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward tables."""

import hashlib
import os
import random
import re
import textwrap
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import blocks, decontaminate, exact_dedup, language_id, license_scan, near_dedup, packing, substring_dedup, suffix_dedup, token_counts, token_files
from tablewright.llm.decontaminate import contamination, drop_contaminated
from tablewright.llm.registry import vocabulary
from tablewright.llm.shared import LOWER, UPPER, ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans(UPPER, LOWER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def table(spark, texts, ids=None):
    """Documents with columns that clash with names the operators use inside."""
    ship_package(spark)
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else "fr", "src0", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("place", F.lit("x")).withColumn("file", F.lit(2)).withColumn("blk", F.lit(3)).withColumn("node", F.lit(4)).withColumn("part", F.lit(5))


def prose(draw, n, vocabulary_size=60):
    return " ".join(f"w{draw.randrange(vocabulary_size)}é" if draw.random() < 0.1 else f"Word{draw.randrange(vocabulary_size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Originals, exact copies, near copies, shared passages, one very long text, nulls and blanks."""
    draw = random.Random(11)
    originals = [prose(draw, draw.randrange(30, 120), 4000) for _ in range(40)]
    passage = prose(draw, 45, 4000)
    texts = list(originals)
    texts += [originals[0]] * 12 + [originals[1].upper(), originals[1].lower()]
    for k in range(60):
        words = originals[2 + k % 3].split(" ")
        for _ in range(draw.randrange(0, 6)):
            words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [f"{prose(draw, 20, 4000)}\n{passage} {prose(draw, 25, 4000)}" for _ in range(15)]
    texts += [" ".join(originals) * 3, None, "", "   \n\t", "one", "one two", "a b c", "a b c", "!!! ??? 123", "x" * 300 + " é" * 40]
    draw.shuffle(texts)
    return texts


AWKWARD = [[], [None], ["", None, " "], ["a"], ["same words here again"] * 5]


# --- 1


def test_language_is_learnt_and_held_out(spark):
    draw = random.Random(2)
    parts = {"en": ["the", "ing", "th", "ed"], "fr": ["é", "eau", "que", "ou"], "de": ["sch", "ung", "ü", "keit"]}
    rows = []
    for i in range(600):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(draw.choices(parts[lang], k=draw.randrange(1, 4))) for _ in range(40)), lang, "s", 0))
    rows += [(600, None, "en", "s", 0), (601, "12345 ...", "en", "s", 0), (602, "", None, "s", 0)]
    ship_package(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.language_id(df, per_language=150).collect()}
    assert len(got) == 603 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (600, 601, 602))
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(600) if got[i].held_out} == set(out)
    assert sum(got[i].lang_pred == rows[i][2] for i in out) / len(out) > 0.98
    kept = {r.doc_id for r in language_id.keep_identified(df, per_language=150).collect()}
    assert set(range(600)) - kept == set() and not kept & {600, 601, 602}


def test_language_without_labels(spark):
    df = table(spark, ["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.language_id(df).collect()} == {("und", 0.0)}
    assert language_id.language_id(table(spark, [])).count() == 0


# --- 2


def test_licences(spark):
    texts = ["prose\nReleased under the MIT License.\nmore", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 1.1.", "The driving licence was lost by the woman.", None, "", "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 3."]
    got = license_scan.scan_licenses(table(spark, texts)).collect()
    sure = {(r.doc_id, r.license) for r in got if r.confirmed}
    assert sure == {(0, "MIT"), (1, "CC-BY-4.0"), (2, "CC-BY-NC-4.0"), (7, "GPL-3.0")}
    assert {r.doc_id for r in got if not r.confirmed} == {3, 4}
    assert license_scan.scan_licenses(table(spark, [])).count() == 0


@pytest.mark.parametrize("name,text", license_scan.TEMPLATES)
def test_each_template_finds_itself(name, text):
    match = license_scan.Scanner().judge(f"  {text}  ")
    assert match.license == name and match.confirmed


def test_each_template_is_found_wrapped(spark):
    prefixes = ["", "# ", " * ", "// "]
    texts = ["\n".join(prefix + line for line in ["Some words of prose.", *textwrap.wrap(text, 70), "More words of prose."]) for _, text in license_scan.TEMPLATES for prefix in prefixes]
    got = license_scan.scan_licenses(table(spark, texts)).where("confirmed").collect()
    assert sorted((r.doc_id, r.license, r.block_line) for r in got) == [(i, license_scan.TEMPLATES[i // len(prefixes)][0], 1) for i in range(len(texts))]


def test_licences_side_by_side_and_alike(spark):
    whole = {name: text for name, text in license_scan.TEMPLATES if len(text) > 800}
    gpl = {v: f"Foo is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version {v} of the License, or\n# (at your option) any later version.\n" for v in (2, 3)}
    numbered = whole["BSD-2-Clause"].replace("met: R", "met:\n1. R").replace("disclaimer. R", "disclaimer.\n2. R").replace("COPYRIGHT HOLDERS AND", "REGENTS AND")
    cases = [
        ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0. Released under the MIT License.", ["Apache-2.0", "MIT", "MIT"]),
        (gpl[2], ["GPL-2.0"]),
        (gpl[3] + gpl[2], ["GPL-2.0", "GPL-3.0"]),
        (numbered, ["BSD-2-Clause"]),
        (whole["BSD-2-Clause"][:140], []),
        ("Licensed under the Apache License, Version 1.1.\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        *((text.replace("copyright holder nor", "Example University nor"), [name]) for name, text in whole.items()),
    ]
    got = license_scan.scan_licenses(table(spark, [text for text, _ in cases])).collect()
    assert [sorted(r.license for r in got if r.confirmed and r.doc_id == i) for i in range(len(cases))] == [names for _, names in cases]
    assert {r.doc_id for r in got if not r.confirmed} >= {5, 6}


def test_short_notices_and_tags(spark):
    cases = [
        ("Distributed under the MIT License.", ["MIT"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("/* SPDX-License-Identifier: Apache-2.0 OR MIT */", ["Apache-2.0", "MIT"]),
        ("# SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause\ntext", ["BSD-3-Clause", "GPL-2.0"]),
        ("SPDX-License-Identifier: MIT-Modern-Variant", []),
        ("SPDX-License-Identifier:", []),
        ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("GNU General Public License, version 2 or later", ["GPL-2.0"]),
        ("The GNU General Public License, version 2 was published in 1991.", []),
        ("Released under the MIT License. SPDX-License-Identifier: ISC\nReleased under the MIT License.", ["ISC", "MIT", "MIT"]),
    ]
    got = license_scan.scan_licenses(table(spark, [text for text, _ in cases])).collect()
    assert [sorted(r.license for r in got if r.confirmed and r.doc_id == i) for i in range(len(cases))] == [names for _, names in cases]
    assert [r.license for r in got if r.doc_id == 4] and all(0 <= r.saving <= 1 for r in got if r.confirmed)


def test_licences_on_awkward_tables(spark):
    """Repeated rows, null and extreme numbers, and a very long text that is judged in parts."""
    notice = "Released under the MIT License."
    long = " ".join(["no such words here"] * 20_000) + f" {notice} " + " ".join(["nor here"] * 20_000)
    ids = [1, 1, None, -(2**63), 2**63 - 1, 5]
    got = license_scan.scan_licenses(table(spark, [notice, notice, notice, notice, notice, long], ids)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.license, r.confirmed) for r in got)) == sorted((i is None, i or 0, "MIT", True) for i in ids)


def test_long_blocks_are_judged_in_parts(monkeypatch):
    draw = random.Random(3)
    scanner = license_scan.Scanner()
    notices = [text for name, text in license_scan.TEMPLATES if name in ("MIT", "Apache-2.0", "ISC") and not text.startswith(license_scan.TAG)]
    text = "\n".join(w for _ in range(60) for w in [draw.choice(notices), "and some words of prose " * draw.randrange(1, 9)])
    sure = lambda: [(m.license, m.line, m.n_missing) for m in scanner.scan(text) if m.confirmed]
    whole = sure()
    monkeypatch.setattr(license_scan, "LONGEST", 3 * scanner.reach)
    assert len(whole) == 60 and sure() == whole


# --- 3


def brute_words(docs, length):
    seen, out = set(), {}
    for doc, text in docs:
        w = re.findall(WORDS, text or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_repeated_windows(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup.remove_repeated_words(table(spark, corpus), texts=True, block_bytes=4000).collect()}
    assert got == brute_words(list(enumerate(corpus)), 20)


def test_payloads_grow_slower_than_blocks_squared(spark, corpus):
    """500 blocks of a few rows; payloads are blocks times buckets at most, and never more than items."""
    from tablewright.llm.blocks import Rounds, sizes_of

    size = sum(len((t or "").encode()) for t in corpus)
    docs = table(spark, corpus)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup.remove_repeated_words(docs, texts=True, block_bytes=size // 500, bucket_bytes=size // 10).collect()}
    assert got == brute_words(list(enumerate(corpus)), 20)
    rounds = Rounds(docs, size // 500, size // 10)
    rounds.ask(lambda block: substring_dedup.Levels(block, 5, 20).questions(), lambda payloads: payloads)
    assert rounds.count >= 500 and rounds.buckets <= 11 and rounds.answers.count() <= len(corpus) * rounds.buckets
    payloads = [k * b for k, b in (sizes_of(t, None, 24_000_000) for t in (10**9, 10**12, 5 * 10**13))]
    assert all(p <= t / 6 for p, t in zip(payloads, (10**9, 10**12, 5 * 10**13)))


@pytest.mark.parametrize("blocks", [10, 10**6])
def test_repeated_windows_of_null_and_repeated_numbers(spark, blocks):
    """Rows of one number, or without any, are one document at any number of blocks."""
    same, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"u{i}" for i in range(25))
    texts, ids = [same] * 12 + [f"x {same}", same, other, f"y {other}", other], [None] * 13 + [1, 5, 5, 6]
    got = substring_dedup.remove_repeated_words(table(spark, texts, ids), block_bytes=blocks).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == sorted([(0, 20, 0)] * 12 + [(0, 21, 20), (1, 20, 20), (5, 25, 0), (5, 26, 25), (6, 25, 25)])


@pytest.mark.parametrize("texts", AWKWARD)
def test_repeated_windows_awkward(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_words(table(spark, texts), length=2, base=1).collect()}
    assert got == {k: v[:3] for k, v in brute_words(list(enumerate(texts)), 2).items()}


# --- 4, 6, 7


def encoded(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


STRANGE = ["<|endoftext|>a<|startoftext|>", "É́ é it's 'LL", "x\x1cy\x85z q", "ΑΣ ΑΣ. İ", "漢字🙂 12３", "aaaa aaa aaaaa!!!!!!", "a" * 5000, "été ecolé"]


def test_token_counts(spark, corpus, library):
    texts = corpus + STRANGE
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table(spark, texts), vocabulary(), 100).collect()}
    assert got == {i: (len((t or "").encode()), n := len(encoded(library, t)), n > 100) for i, t in enumerate(texts)}


def test_token_files(spark, corpus, library):
    texts = corpus + STRANGE
    ids = [7 * i - 100 for i in range(len(texts))]
    df = table(spark, texts[::-1], ids[::-1])
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digests(df, vocabulary()).collect()}
    start = 0
    for i, t in zip(ids, texts):
        e = np.append(encoded(library, t), 2).astype("<u4")
        assert got[i] == (start, len(e), zlib.crc32(e.tobytes()))
        start += len(e)


def test_token_files_by_number(spark, tmp_path, library):
    df = table(spark, ["first text", "second", None])
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_token_files(df, folder, vocabulary())
    found = token_files.read_documents(folder, manifest, [1, 2, 99])
    assert set(found) == {1, 2} and list(found[1]) == [*encoded(library, "second"), 2] and list(found[2]) == [2]


@pytest.mark.parametrize("texts", AWKWARD)
def test_token_files_awkward(spark, texts):
    assert token_files.token_file_digests(table(spark, texts), vocabulary()).count() == len(texts)
    assert packing.pack(table(spark, texts), vocabulary()).select("doc_id").distinct().count() == len(texts)
    assert token_counts.count_tokens(table(spark, texts), vocabulary()).count() == len(texts)


def test_packing(spark, corpus, library):
    window = 256
    pieces = packing.pack(table(spark, corpus).repartition(3), vocabulary(), window, shard_tokens=6000).collect()
    ids = {i: np.append(encoded(library, t), 2).astype("<u4") for i, t in enumerate(corpus)}
    of_doc, of_sequence = {}, {}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        of_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        of_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))

    def total(parts):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        return at

    assert {d: total(x) for d, x in of_doc.items()} == {d: len(x) for d, x in ids.items()}
    sizes = [total(x) for x in of_sequence.values()]
    assert all(s <= window and s & (s - 1) == 0 for s in sizes) and sorted(of_sequence) == list(range(len(sizes)))


def test_retrieval_puts_neighbours_together():
    draw = np.random.default_rng(1)
    topics = [draw.integers(1000 * k, 1000 * k + 200, (20, 50)) for k in range(4)]
    docs = np.concatenate(topics)[draw.permutation(80)]
    order = packing.order_by_retrieval(docs.reshape(-1), np.arange(81) * 50, 400)
    topic = docs[order, 0] // 1000
    assert sorted(order) == list(range(80)) and (topic[1:] == topic[:-1]).mean() > 0.7


def test_packing_takes_all_neighbours_of_the_seed():
    # The seed shares one term of its own with each of 100 documents, and these share more with strangers than with each other.
    docs = [np.arange(100)] + [np.array([k, 1000 + k, 2000 + k]) for k in range(100)] + [np.array([1000 + k, 2000 + k, 3000 + k]) for k in range(100)]
    order = packing.order_by_retrieval(np.concatenate(docs), np.cumsum([0] + [len(d) for d in docs]), 512)
    assert sorted(order) == list(range(201)) and set(order[1:101]) == set(range(1, 101))


# --- 5


def brute_exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_exact_copies(spark, corpus):
    got = [tuple(r) for r in exact_dedup.exact_dedup(table(spark, corpus)).collect()]
    assert set(got) == brute_exact(list(enumerate(corpus))) and len(got) == len(corpus)
    kept = exact_dedup.drop_exact_copies(table(spark, corpus))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in got if r[3]} and kept.columns == table(spark, corpus).columns


def test_colliding_digests_are_told_apart_by_bytes(spark, corpus):
    got = {tuple(r) for r in exact_dedup.exact_dedup(table(spark, corpus), key_bytes=1).collect()}
    assert got == brute_exact(list(enumerate(corpus)))


def test_only_rows_and_texts_that_may_be_copies_are_sent(spark, monkeypatch):
    """Rows and texts are held against a bitmap before they are shuffled, and none is lost: hot groups and others, null texts and numbers."""
    texts = [f"text {i}" for i in range(300)] + ["copy", "COPY", "copy", None, "", "text 7"]
    df = table(spark, texts, [*range(304), None, None])
    want = brute_exact([(i, t) for i, t in enumerate(texts) if i < 299 and i != 7])
    sent, plain = [], decontaminate.among
    monkeypatch.setattr(decontaminate, "among", lambda rows, wanted, *c: sent.append((plain(rows, wanted, *c), wanted, c)) or sent[-1][0])
    got = [exact_dedup.exact_dedup(df).collect()]
    assert [c for _, _, c in sent] == [("key",), ("file", "place")]
    assert [(found.count(), found.join(wanted.select(*c).distinct(), [*c]).count()) for found, wanted, c in sent] == [(7, 7), (7, 7)]
    monkeypatch.setattr(exact_dedup, "HOT_PART", 1)  # no digest is hot
    monkeypatch.setattr(decontaminate, "BUCKETS", 1)  # and many places share a bit
    got.append(exact_dedup.exact_dedup(df).collect())
    for rows in got:
        assert len(rows) == 306 and want <= {tuple(r) for r in rows}
        copies = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows if r.group_size > 1)
        assert copies == [(False, 7, 7, 2, True), (False, 300, 302, 3, False), (False, 301, 302, 3, False), (False, 302, 302, 3, True), (False, 303, 303, 2, True), (True, 0, 7, 2, False), (True, 0, 303, 2, False)]


def test_exact_awkward(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    ids = [5, 5, None, None, 7]
    got = exact_dedup.exact_dedup(table(spark, ["A", "a", "a", None, ""], ids)).collect()
    assert sorted((r.group_size, r.kept) for r in got) == [(2, False), (2, True), (3, False), (3, False), (3, True)]
    assert {r.keep_id for r in got if r.group_size == 3} == {5}


# --- 8


def shingle_set(text, n):
    w = re.findall(WORDS, (text or "").translate(FOLD))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("most,buckets", [(1_000_000, 512), (0, 512), (0, 1), (1_000_000, 1)])
def test_contained_items(spark, corpus, monkeypatch, most, buckets):
    """Sketches broadcast and shuffled, with a bitmap that lets few others through and one that is far too small."""
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", most)
    monkeypatch.setattr(decontaminate, "BUCKETS", buckets)
    draw = random.Random(5)
    items = [prose(draw, draw.randrange(6, 40), 4000) for _ in range(12)] + ["one two", "", None]
    texts = list(corpus)
    for k, item in enumerate(items[:12]):
        words = item.split(" ")
        if k % 2:
            words[-1] = "changed"
        texts.append(f"{prose(draw, 400, 4000)} {' '.join(words)} {prose(draw, 300, 4000)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    own = {i: s for i, t in enumerate(items) if (s := shingle_set(t, 5))}
    expected = {(d, i, len(s), n) for d, t in enumerate(texts) for i, s in own.items() if (n := len(s & shingle_set(t, 5))) * 5 >= 4 * len(s)}
    got = contamination(table(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == expected and len(got) == len(expected) > 6
    left = {r.doc_id for r in drop_contaminated(table(spark, texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, *_ in expected}
    assert contamination(table(spark, []), bench).count() == 0 == contamination(table(spark, texts), bench.limit(0)).count()


def test_bitmaps_lose_nothing(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("a"), F.md5(F.col("id").cast("string")).alias("b"))
    wanted = rows.where("a % 7 = 0")
    held = {r.a for r in decontaminate.among(rows, wanted, "a", "b").collect()}
    others = {r.a for r in decontaminate.among(rows, wanted, "a", "b", others=True).collect()}
    assert held >= set(range(0, 20_000, 7)) and len(held) < 3_000 and held | others == set(range(20_000)) and not held & others
    monkeypatch.setattr(decontaminate, "BUCKETS", 1)
    assert {r.a for r in decontaminate.among(rows, wanted, "a", "b").collect()} >= set(range(0, 20_000, 7))
    assert decontaminate.among(rows, wanted.limit(0), "a", "b").count() == 0


def test_repeated_items_and_rows(spark):
    text, ids = "one two three four five six seven", [3, 3, None, 4]
    bench = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (5, None)], "item_id long, text string")
    got = contamination(table(spark, [text, text, text, "else"], ids), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == sorted((str(d), str(i)) for d in (3, 3, None) for i in (1, 1, 2, None))
    assert [r.doc_id for r in drop_contaminated(table(spark, [text, text, text, "else"], ids), bench).collect()] == [4]


# --- 9


def brute_bytes(docs, length):
    seen, out = set(), {}
    for doc, text in docs:
        b = (text or "").encode()
        gone, own = bytearray(len(b)), set()
        for i in range(len(b) - length + 1):
            window = b[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\x01" * length
            own.add(window)
        seen |= own
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_earlier_bytes(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_earlier_bytes(table(spark, corpus), block_bytes=4000).collect()}
    assert got == brute_bytes(list(enumerate(corpus)), 50)


@pytest.mark.parametrize("texts", [[], [None], ["", None], ["a" * 49, "a" * 49], ["a" * 200, "b" + "a" * 120], ["é" * 60, "xé" * 5 + "é" * 40]])
def test_earlier_bytes_awkward(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_earlier_bytes(table(spark, texts)).collect()}
    assert got == brute_bytes(list(enumerate(texts)), 50)


def test_merged_transforms_are_the_sorted_suffixes():
    draw = np.random.default_rng(3)
    shards = [[bytes(draw.integers(97, 100, draw.integers(60, 90)).astype(np.uint8)) for _ in range(6)] for _ in range(4)]
    shards[2][0] = shards[0][0]
    docs = [np.arange(6) + 10 * k for k in range(4)]
    got = suffix_dedup.earlier_windows([(np.frombuffer(b"".join(s), np.uint8), np.array([len(x) for x in s]), d) for s, d in zip(shards, docs)], 50)
    first = {}
    for s, d in zip(shards, docs):
        for x, n in zip(s, d):
            for i in range(len(x) - 49):
                first[x[i : i + 50]] = min(n, first.get(x[i : i + 50], n))
    for s, d, flags in zip(shards, docs, got):
        assert list(flags) == [int(first[x[i : i + 50]] < n) for x, n in zip(s, d) for i in range(len(x) - 49)]


class LocalRounds:
    """Rounds in this process, over blocks of every third text; keeps the questions of each round."""

    def __init__(self, texts, *_):
        rows = [(i, t or "") for i, t in enumerate(texts)]
        self.blocks = [pa.table({"doc_id": pa.array([i for i, _ in rows[k::3]], pa.int64()), "text": pa.array([t for _, t in rows[k::3]], pa.string())}) for k in range(3)]
        self.answers, self.asked = [[] for _ in self.blocks], []

    def block(self, k):
        columns = dict(zip(("bucket", "round", "payload"), zip(*self.answers[k]))) or {"bucket": [], "round": [], "payload": []}
        return blocks.Block(self.blocks[k], pa.table({n: pa.array(v) for n, v in columns.items()}), k, 5)

    def ask(self, questions, answer, **_):
        asked = [(b, k, p) for k in range(3) for b, p in questions(self.block(k))]
        for bucket in sorted({b for b, _, _ in asked}):
            own = [(k, p) for b, k, p in asked if b == bucket]
            for (k, _), reply in zip(own, [p for _, p in own] if bucket < 0 else answer([p for _, p in own])):
                self.answers[k].append((bucket, len(self.asked), reply))
        self.asked.append(sum(len(p) for b, _, p in asked if b >= 0))

    def finish(self, work, _):
        return self, [r for k in range(3) for r in work(self.block(k)).to_pylist()]


def local_bytes(monkeypatch, texts):
    monkeypatch.setattr(suffix_dedup, "Rounds", LocalRounds)
    rounds, rows = suffix_dedup.remove_earlier_bytes(texts)
    return rounds, {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


@pytest.mark.parametrize("hot", [4096, 2, 0])
def test_earlier_bytes_of_pieces(corpus, monkeypatch, hot):
    """Passages of 40 to 90 bytes between chance bytes, in one and in several documents; hot ones go by window."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    draw = random.Random(5)
    passages = ["".join(draw.choice("abcde ") for _ in range(n)) for n in range(40, 91, 5)]
    texts = ["".join("".join(draw.choice("abcde ") for _ in range(draw.randrange(3, 40))) + draw.choice(passages) for _ in range(draw.randrange(0, 8))) for _ in range(80)]
    texts += texts[:5] + [None, "z" * 400, "z" * 90, "ab" * 60, "x" + "ab" * 40]
    assert local_bytes(monkeypatch, texts)[1] == brute_bytes(list(enumerate(texts)), 50)
    assert local_bytes(monkeypatch, corpus)[1] == brute_bytes(list(enumerate(corpus)), 50)


def test_what_shares_only_anchors_is_not_merged(monkeypatch):
    """Strings of 30 bytes that very many texts share hold no common string of 50 bytes: their surroundings are not sent."""
    draw = random.Random(6)
    phrases = ["".join(draw.choice("abcdefgh") for _ in range(30)) for _ in range(4)]
    chance = lambda: "".join(draw.choice("abcdefgh") for _ in range(60))
    texts = [chance() + draw.choice(phrases) + chance() for _ in range(300)]
    rounds, got = local_bytes(monkeypatch, texts)
    assert got == brute_bytes(list(enumerate(texts)), 50)
    assert rounds.asked[2] and not rounds.asked[3]


def test_replies_of_a_round_are_made_once(spark, tmp_path):
    """Later rounds and the result use a round's replies again."""
    folder = str(tmp_path)

    def answer(payloads):
        open(f"{folder}/{payloads[0].decode()}-{uuid.uuid4().hex}", "w").close()
        return payloads

    ship_package(spark)
    rounds = blocks.Rounds(table(spark, ["a", "b", "c"]), None, 10**6)
    for level in range(3):
        rounds.ask(lambda block, level=level: [(0, f"round{level}".encode())], answer, dear=level == 2)
    got = rounds.finish(lambda block: pa.table({"n": pa.array([len(block.answered(level)) for level in range(3)], pa.int64())}), "n long").collect()
    assert got and all(r.n == 1 for r in got)
    assert sorted(f.split("-")[0] for f in os.listdir(folder)) == ["round0", "round1", "round2"]


# --- 10


def brute_components(docs, percent, n):
    sets = {i: shingle_set(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "SEARCH_BLOCK", 5)
    for percent, n in ((85, 3), (80, 5)):
        got = {tuple(r) for r in near_dedup.link_documents(table(spark, corpus), percent, n).collect()}
        assert got == brute_components(list(enumerate(corpus)), percent, n)
    kept = near_dedup.keep_one_of_each(table(spark, corpus))
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute_components(list(enumerate(corpus)), 80, 5) if r[3]}


def test_chains_of_links(spark):
    words = [f"v{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"u{j}" for j in range(k, 60)]) for k in range(0, 61, 3)]
    got = {tuple(r) for r in near_dedup.link_documents(table(spark, texts), 85, 3).collect()}
    assert got == brute_components(list(enumerate(texts)), 85, 3)


@pytest.mark.parametrize("texts", AWKWARD)
def test_near_awkward(spark, texts):
    got = {tuple(r) for r in near_dedup.link_documents(table(spark, texts), 85, 3).collect()}
    assert got == brute_components(list(enumerate(texts)), 85, 3)


def test_near_null_numbers(spark):
    got = near_dedup.link_documents(table(spark, ["a b c d", "a b c d", "x y z"], [None, 4, 4]), 85, 3).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (4, None)}


def test_kept_rows_of_null_and_repeated_numbers(spark):
    near = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(1, 41))]
    other = [" ".join(f"v{i}" for i in range(40)), " ".join(f"v{i}" for i in range(1, 41))]
    texts, ids = [*near, *other, other[0], other[0], None, None, ""], [None, None, 7, 7, 7, 8, None, 3, 3]
    kept = near_dedup.keep_one_of_each(table(spark, texts, ids), percent=80, n=3).collect()
    words = [r for r in kept if r.text]
    assert len(words) == 2 and {r.text.split()[0][0] for r in words} == {"v", "w"} and {r.doc_id for r in words} == {None, 7}
    assert len(kept) - len(words) == 3


def test_cluster_whose_centre_lies_outside(spark, monkeypatch):
    """Members that link with one another, not with the centre, are joined by few links."""
    monkeypatch.setattr(near_dedup, "SEARCH_BLOCK", 16)
    draw = np.random.default_rng(3)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for family in range(3):
        own = [f"f{family}{w}" if draw.random() < 0.06 else w for w in base]
        texts += [" ".join([*own, f"tail{family}{k}"]) for k in range(40)]
    got = {tuple(r) for r in near_dedup.link_documents(table(spark, texts), 85, 3).collect()}
    assert got == brute_components(list(enumerate(texts)), 85, 3)


def test_a_block_gives_no_more_links_than_members():
    import pandas as pd

    sets = [np.arange(100, dtype=np.int64) + k for k in range(20)]
    sign = near_dedup.signatures([s.view(np.uint64) for s in sets])
    rows = pd.DataFrame([(k, k, side, 100, sign[k].tobytes(), sets[k]) for side in (0, 1) for k in range(20)], columns=["node", "label", "side", "n", "signature", "shingles"])
    found = near_dedup.block_links(rows, 80)
    assert len(found) == 19


@pytest.mark.parametrize("percent", [80, 85])
def test_pigeonhole_finds_every_pair_within_the_distance(percent):
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 16, (200, near_dedup.SYMBOLS)).astype(np.uint16)
    other = base.copy()
    for row in other:
        row[draw.choice(near_dedup.SYMBOLS, near_dedup.distance_for(percent), replace=False)] ^= 1
    assert all(set(a) & set(b) for a, b in zip(near_dedup.index_keys(base, percent), near_dedup.index_keys(other, percent)))


def test_words_are_split_in_bytes():
    from tablewright.llm.words import words_of

    texts = ["a  b\tc", "", "é\x0bz", None, " q"]
    found = words_of(pa.array(texts), fold=False)
    assert list(np.diff(found.bounds)) == [len(re.findall(WORDS, t or "")) for t in texts]

"""The stages one after the other: on a small table, against brute force, and on awkward tables."""

import random
import zlib

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
import __spark_entry__
from tablewright.llm import language_id
from tablewright.llm.registry import END_ID, WINDOW_TOKENS, vocabulary
from test_llm import FOLD, SCHEMA, brute_components, shingle_set

PARTS = {"en": ["the", "ing", "th", "ed", "ow"], "fr": ["é", "eau", "que", "ou", "à"], "de": ["sch", "ung", "ü", "keit", "ß"], "nl": ["ij", "aan", "oe", "ooi", "veld"]}


def staged(spark, sf, folder):
    """Run the stages on the tables in ``sf``; rows after each of them, and the last result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs.count())
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    return seen, docs


def write(spark, folder, rows, items, more=()):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in more:
        docs = docs.selectExpr("*", f"doc_id AS `{name}`")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    seen, docs = staged(spark, sf, tmp_path)
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    before = spark.read.parquet(f"{tmp_path}/decontamination")
    assert docs.select("doc_id").distinct().count() == before.count() and END_ID == 2


def made_up(draw):
    """Documents (doc_id, text, lang) and benchmark items."""
    def prose(lang, n):
        return [" ".join("".join(draw.choices(PARTS[lang], k=draw.randrange(1, 6))) for _ in range(n))][0]

    originals = [(lang, prose(lang, draw.randrange(30, 80))) for _ in range(30) for lang in PARTS]
    items = [prose(draw.choice(list(PARTS)), draw.randrange(8, 20)) for _ in range(8)]
    docs = list(originals)
    docs += [(originals[k % 3][0], originals[k % 3][1].upper() if k % 2 else originals[k % 3][1]) for k in range(9)]
    for k in range(16):
        lang, text = originals[3 + k % 3]
        words = text.split(" ")
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = f"ander{k}"
        docs.append((lang, " ".join(words)))
    for k, item in enumerate(items):
        words = item.split(" ")
        if k % 3 == 2:
            words = words[: len(words) // 2]  # too little of it
        docs.append(("en", f"{prose('en', 25)} {' '.join(words)}\n{prose('en', 25)}"))
    docs += [("en", t) for t in (None, "", "123 !!!", " \n\t", "the")] + [(None, prose("fr", 40)), ("de", " ".join(t for _, t in originals))]
    draw.shuffle(docs)
    ids = draw.sample(range(-1000, 10**6), len(docs))
    return [(i, text, lang) for i, (lang, text) in zip(ids, docs)], items


def test_against_brute_force(spark, tmp_path):
    docs, items = made_up(random.Random(6))
    write(spark, tmp_path, [(i, t, lang, "s", len(t or "")) for i, t, lang in docs], list(enumerate([*items, items[0], None, ""])))
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    network = language_id.train_language_network(table.select("doc_id", "text", "lang").where(language_id.fold_of(table.doc_id) != 2))
    left = [(i, t) for i, t, _ in docs if regex.search(r"\p{L}", t or "") and network.judge([t.encode()])[1][0] >= 0.3]
    assert len(docs) - len(left) >= 4
    best = {}
    for i, t in left:
        best[t.translate(FOLD)] = max(i, best.get(t.translate(FOLD), i))
    left = [(i, t) for i, t in left if best[t.translate(FOLD)] == i]
    one = {r[0] for r in brute_components(left, 80, 5) if r[3]}
    left = [(i, t) for i, t in left if i in one]
    held = [s for t in items if (s := shingle_set(t, 5))]
    kept = {i: t for i, t in left if not any(len(s & shingle_set(t, 5)) * 5 >= 4 * len(s) for s in held)}
    assert len(docs) > len(best) > len(one) > len(kept) > 100
    library, of_doc, of_sequence = Tokenizer.from_file(vocabulary()), {}, {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = np.array([*library.encode(kept[p.doc_id], add_special_tokens=False).ids, END_ID], "<u4")
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        of_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        of_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(of_doc) == set(kept)
    for pieces in of_doc.values():
        assert sorted(s for s, _, _ in pieces) == [sum(n for _, n, _ in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n, _ in pieces) == pieces[0][2]
    sizes = []
    for pieces in of_sequence.values():
        assert sorted(s for s, _ in pieces) == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        sizes.append(sum(n for _, n in pieces))
    assert all(n <= WINDOW_TOKENS and n & n - 1 == 0 for n in sizes)


def run_of(letter, start, stop):
    return " ".join(f"{letter}{i}" for i in range(start, stop))


AWKWARD = {
    "empty": ([], set()),
    "nulls": ([(None, None, None, None, None)] * 3, set()),
    # No row has a language, so every text with a letter is kept by the first stage.
    "mixed": (
        [(7, run_of("w", 0, 40), None, None, None)] * 2
        + [(None, run_of("W", 0, 40), None, "s", 1), (None, run_of("v", 0, 40), None, "s", 1), (3, run_of("v", 1, 41), None, "s", 1), (9, f"u {run_of('b', 0, 12)} u", None, "s", 1), (11, run_of("x", 0, 60_000), None, "s", 1), (12, "", None, "s", 1), (13, "1 2 3", None, "s", 1)],
        {7, None, 11},
    ),
}


@pytest.mark.parametrize("name", AWKWARD)
def test_awkward_tables(spark, tmp_path, name):
    """Nulls, repeated rows, a very long text, columns with names used inside, repeated and null items."""
    rows, kept = AWKWARD[name]
    write(spark, tmp_path, rows, [] if name == "empty" else [(1, run_of("b", 0, 12)), (1, run_of("b", 0, 12)), (None, None)], more=("row", "file", "place", "key", "node", "score"))
    seen, pieces = staged(spark, tmp_path, f"{tmp_path}/out")
    whole = pieces.groupBy("doc_id").sum("length").count()
    assert {r.doc_id for r in pieces.collect()} == kept and whole == len(kept) == seen[3]


def test_all_operators_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()

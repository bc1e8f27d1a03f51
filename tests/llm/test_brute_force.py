"""Parts of operators that SQL cannot express, against plain loops."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import zstandard

from tablewright.llm import language_id, license_scan, packing

# --- 1: the network


def plain_probabilities(network, row):
    """One window, by one-hot bytes and a loop over places and filters."""
    hidden = []
    for kernel in network.filters:
        width, _, filters = kernel.shape
        for f in range(filters):
            hidden.append(max(sum(float(kernel[j, row[i + j], f]) for j in range(width)) for i in range(len(row) - width + 1)))
    hidden = [max(h + float(b), 0) for h, b in zip(hidden, network.bias)]
    logits = [sum(h * float(w) for h, w in zip(hidden, network.out[:, c])) + float(network.out_bias[c]) for c in range(len(network.languages))]
    top = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(top) for x in top]


def test_network_is_a_plain_convolution():
    draw = np.random.default_rng(4)
    network = language_id.ByteNetwork.new(["a", "b", "c"], 24, 3, seed=1)
    network.bias += draw.normal(0, 0.2, network.bias.shape).astype(np.float32)
    rows = draw.integers(0, 256, (6, 24), np.uint8)
    assert np.allclose(network.probabilities(rows), [plain_probabilities(network, r) for r in rows.tolist()], atol=1e-4)


def test_pooling_holds_few_sums_and_gives_the_same_bits():
    """More windows need no more memory for sums; each window's values and places are those of plain sums, in the same order."""
    network = language_id.ByteNetwork.new(["a", "b"], 64, 4, seed=6)
    rows = np.random.default_rng(8).integers(0, 256, (4 * language_id.TOGETHER + 5, 64), np.uint8)
    rows[:, 40:] = 0  # padding, where places tie
    tops, places = network.pooled(rows, where=True)
    assert np.array_equal(tops, network.pooled(rows)[0])
    for kernel, at, lane in zip(network.filters, places, range(0, 16, 4)):
        valid = 64 - len(kernel) + 1
        sums = kernel[0][rows[:, :valid]]
        for j in range(1, len(kernel)):
            sums = sums + kernel[j][rows[:, j : j + valid]]
        assert np.array_equal(tops[:, lane : lane + 4], sums.max(1) + network.bias[lane : lane + 4]) and np.array_equal(at, sums.argmax(1))
    assert network.pooled(rows[:0], where=True)[0].shape == (0, 16)
    many = np.tile(rows, (40, 1))
    tracemalloc.start()
    network.pooled(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < many.size * 4  # the sums of one filter over all windows alone hold this much


def test_texts_are_judged_by_all_their_windows():
    draw = random.Random(9)
    network = language_id.ByteNetwork.new(["a", "b"], 16, 2, seed=5)
    texts = [bytes(draw.randrange(32, 250) for _ in range(n)) for n in (1, 15, 16, 17, 100)]
    best, score = network.judge(texts)
    for text, b, s in zip(texts, best, score):
        total = np.zeros(2)
        for at in range(0, len(text), 16):
            window = text[at : at + 16]
            total += len(window) * np.array(plain_probabilities(network, list(window.ljust(16, b"\0"))))
        total /= len(text)
        assert b == total.argmax() and s == pytest.approx(total.max(), abs=1e-4)


def test_training_follows_the_slope_of_the_loss():
    """A step along the gradient of one batch lowers its loss."""
    draw = np.random.default_rng(2)
    rows, labels = draw.integers(0, 256, (32, 24), np.uint8), np.arange(32) % 2
    network = language_id.ByteNetwork.new(["a", "b"], 24, 4, seed=3)
    loss = lambda: -np.log(network.probabilities(rows)[np.arange(32), labels]).mean()
    before = loss()
    network.train(rows, labels, epochs=1, seed=1, rate=0.001, size=64)
    assert loss() < before


# --- 2: places of a template


TEMPLATES = [
    ("ONE", "this work may be used under the first open license of the river board"),
    ("TWO", "this work may be used under the second open license of the river board"),
    ("OTHER", "copyright stays with makers and all copies must carry this very notice"),
]


def plain_places(scanner, k, words):
    """(start, end, missing, extra) of the cheapest start for each end, by trying all starts."""
    template, costs = scanner.words[k], scanner.costs[k]
    number = lambda w: scanner.number.get(w, -1)
    between = [int(scanner.between[k][number(w)]) for w in words]
    best = {}
    for start in range(len(words)):
        row = [0]
        for cost in costs:
            row.append(row[-1] + int(cost))
        for end in range(start + 1, min(start + scanner.reach + 1, len(words)) + 1):
            new = [row[0] + between[end - 1]]
            for i, (word, cost) in enumerate(zip(template, costs)):
                cheapest = min(row[i + 1] + between[end - 1], new[i] + int(cost))
                new.append(min(cheapest, row[i]) if word == words[end - 1] else cheapest)
            row = new
            best[end] = min(best.get(end, (1 << 60, 0)), (row[-1], -start))
    found = []
    for end, (cost, start) in best.items():
        ruled_out, cost = divmod(cost, license_scan._RULED_OUT)
        spare = end + start - len(template)  # words of the place beyond those of the template
        missing = (cost - spare) // (license_scan._MISSING + 1)
        extra = spare + missing
        if not ruled_out and missing <= license_scan.MOST_MISSING * len(template) and extra <= license_scan.MOST_EXTRA * len(template):
            found.append((-start, end, missing, extra))
    return found


def test_licences_against_all_windows():
    draw = random.Random(17)
    scanner = license_scan.Scanner(TEMPLATES)
    filler = [f"w{chr(97 + i)}" for i in range(20)]
    confirmed = 0
    for _ in range(80):
        words = [draw.choice(filler) for _ in range(draw.randrange(12))]
        for _ in range(draw.randrange(3)):
            own = draw.choice(TEMPLATES)[1].split()
            for _ in range(draw.randrange(3)):
                del own[draw.randrange(len(own))]
            for _ in range(draw.randrange(4)):
                own.insert(draw.randrange(len(own) + 1), draw.choice([*filler, "second", "makers"]))
            words += own + [draw.choice(filler) for _ in range(draw.randrange(6))]
        text = "".join(w + draw.choice([" ", "\n", "\n# "]) for w in words)
        places = [(name, p) for k, (name, _) in enumerate(TEMPLATES) for p in plain_places(scanner, k, words)]
        cue = [w.startswith("licens") or w == "copyright" for w in words]
        sure = {name for name, (start, end, _, _) in places if any(cue[start:end])}
        got = [m for m in scanner.scan(text) if m.confirmed]
        assert bool(got) == bool(sure) and {m.license for m in got} <= {name for name, _ in places}
        assert all((m.license, m.n_missing, m.n_extra) in {(name, p[2], p[3]) for name, p in places} for m in got)
        confirmed += len(got)
    assert confirmed > 20


def plain_winners(scanner, templates, text, words, a, b):
    """Confirmed (licence, start, end, missing, extra) of a block: all templates are compressed and aligned, the most bytes saved win, then what is left."""
    if not any(w.startswith("licens") or w == "copyright" for w in words[a:b]):
        return []
    block = text.between(a, b).encode()
    plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    best = None
    for k, (name, template) in enumerate(templates):
        known = zstandard.ZstdCompressionDict(template.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        saved = len(plain.compress(block)) - len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False, dict_data=known).compress(block))
        places = plain_places(scanner, k, words[a:b])
        if places and (best is None or saved > best[0]):
            best = (saved, k, places)
    if best is None:
        return []
    taken, found = [False] * (b - a), []
    for start, end, missing, extra in sorted(best[2], key=lambda p: (license_scan._MISSING * p[2] + p[3], p[1])):
        if not any(taken[start:end]):
            taken[start:end] = [True] * (end - start)
            found.append((templates[best[1]][0], a + start, a + end, missing, extra))
    edges = [a, *sorted(at for f in found for at in f[1:3]), b]
    return found + [f for i in range(0, len(edges), 2) for f in plain_winners(scanner, templates, text, words, edges[i], edges[i + 1])]


def test_the_best_saving_among_all_templates_wins(monkeypatch):
    """Two wordings fit one place; what the compressor saves chooses between them, and no other order gives these results."""
    templates = [*TEMPLATES, ("PART", "under the first open license"), ("PART", "under the second open license")]
    scanner = license_scan.Scanner(templates)
    draw = random.Random(23)
    texts = []
    for _ in range(40):
        words = []
        for _ in range(draw.randrange(1, 4)):
            words += [draw.choice("pqrstu") * 3 for _ in range(draw.randrange(1, 9))] + draw.choice(templates)[1].split()
        texts.append("".join(w + draw.choice([" ", "\n"]) for w in words))

    def winners(text):
        return sorted((m.license, m.begin, m.end, m.n_missing, m.n_extra) for m in scanner.scan(text) if m.confirmed)

    wanted = []
    for text in texts:
        held = license_scan.Text(text, scanner.cue, scanner.number)
        wanted.append(sorted(f for a, b in held.blocks(scanner.reach) for f in plain_winners(scanner, templates, held, held.words, a, b)))
    assert [winners(t) for t in texts] == wanted and sum(map(len, wanted)) > 40
    rank = scanner.rank
    monkeypatch.setattr(scanner, "rank", lambda block: rank(block)[::-1])
    assert [winners(t) for t in texts] != wanted


# --- 7: BM25


def plain_scores(docs, seed, k1=1.2, b=0.75):
    counts = [Counter(d) for d in docs]
    mean = sum(map(len, docs)) / len(docs)
    scores = []
    for own, doc in zip(counts, docs):
        total = 0.0
        for term in counts[seed]:
            df = sum(term in c for c in counts)
            if df > 1 and own[term]:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                total += idf * own[term] * (k1 + 1) / (own[term] + k1 * (1 - b + b * len(doc) / mean))
        scores.append(total)
    return scores


def some_documents():
    draw = random.Random(23)
    weights = [1 / (1 + k) for k in range(300)]
    return [draw.choices(range(300), weights, k=draw.randrange(1, 60)) for _ in range(70)]


def test_neighbours_are_ranked_by_bm25():
    docs = some_documents()
    ids, offsets = np.array([x for d in docs for x in d]), np.cumsum([0, *map(len, docs)])
    index, used = packing.LexicalIndex(ids, offsets), np.zeros(len(docs), bool)
    for round_ in range(2):
        for seed in range(len(docs)):
            scores = plain_scores(docs, seed)
            assert np.allclose(index.scores(seed), np.array(scores)[index.live])
            held = used.copy()
            held[seed] = True
            got = list(index.neighbours(seed, held, most=3))
            assert sorted(got) == [d for d in range(len(docs)) if not held[d] and scores[d] > 0]
            assert all(scores[x] >= scores[y] - 1e-9 for x, y in zip(got, got[1:]))
        used[::3] = True
        index.forget(used)


def test_order_is_the_greedy_one():
    docs, window = some_documents(), 256
    ids, offsets = np.array([x for d in docs for x in d]), np.cumsum([0, *map(len, docs)])
    order, left, filled, seed = [], list(range(len(docs))), 0, None

    def take(doc):
        nonlocal filled
        left.remove(doc)
        order.append(doc)
        filled += len(docs[doc])

    while left:
        if seed is None:
            seed = left[0]
            take(seed)
        window_of, last = filled // window, seed
        if filled % window:
            scores = plain_scores(docs, seed)
            for near in sorted((d for d in left if scores[d] > 0), key=lambda d: (-scores[d], d)):
                take(near)
                last = near
                if filled // window > window_of:
                    break
        seed = last if last != seed and filled % window else None
    assert packing.order_by_retrieval(ids, offsets, window).tolist() == order

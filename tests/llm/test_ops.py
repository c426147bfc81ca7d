"""The text-corpus operators against brute force on small fixtures with the awkward rows: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.llm import align, bpetree, chaining, covertree, decontaminate, jaccard, katz, langid, licenses, pack, queries, resample, suffixes, toxicity
from barloom.llm.common import small_batches

TR = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, k int"


def words(t):
    return [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().translate(TR)) if x]


def texts():
    g = random.Random(5)
    vocab = ["".join(g.choice("abcdefgh") for _ in range(g.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(g.choice(vocab) for _ in range(n))
    out = [make(g.randint(5, 120)) for _ in range(60)]
    passage, long = make(70), make(4000)
    out += [out[0], out[0], out[1] + " tail words", passage, make(30) + " " + passage + " " + make(20), make(10) + " " + passage, "", None, "  \n\t", "ein", "Same same SAME", long, long + " more"]
    for _ in range(20):  # near copies of one text
        w = out[2].split() + make(60).split() if False else (out[2] + " " + passage).split()
        for _ in range(g.randint(1, 6)):
            w[g.randrange(len(w))] = g.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    rows = [(i, t, "en", "s", len(t or ""), 7, 1) for i, t in enumerate(texts())] + [(None, "no id at all here", "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}


def find(up, i):
    while up[i] != i:
        i = up[i]
    return i


def test_suffix_arrays(docs):
    t = {i: (x or "").encode() for i, x in rows_of(docs).items()}
    seen = Counter(x[k : k + 200] for x in t.values() for k in range(len(x) - 199))
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    assert set(got) == set(t)
    for i, x in t.items():
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"], bytes(got[i]["kept"])) == (len(x), gone.sum(), hashlib.sha256(kept).hexdigest(), kept)
        assert got[i]["n_spans"] == (np.diff(gone.astype(int), prepend=0) == 1).sum()


def test_suffix_arrays_hot_key(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    test_suffix_arrays(docs)


def repeats_by_brute_force(rows, width):
    """n_removed of each row (doc_id, text), in order."""
    t = [(x or "").encode() for _, x in rows]
    seen = Counter(x[k : k + width] for x in t for k in range(len(x) - width + 1))
    out = []
    for x in t:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - width + 1):
            if seen[x[k : k + width]] > 1:
                gone[k : k + width] = True
        out.append(int(gone.sum()))
    return out


def test_suffix_arrays_of_shared_ids_and_common_lines(spark, monkeypatch):
    """A line of every row, a passage of many amid other words, and doc_ids that several rows have."""
    g = random.Random(11)
    make = lambda n: "".join(g.choice("abcd ") for _ in range(n))
    line, passage = make(90), make(330)
    rows = [(i, make(40 + i) + line + make(150) + (passage if i % 3 == 0 else "") + make(i % 7) + line) for i in range(40)]
    rows += [(7, make(500)), (9, rows[3][1]), (9, rows[3][1]), (50, ""), (51, None)]
    want = sorted((i, n) for (i, _), n in zip(rows, repeats_by_brute_force(rows, 200), strict=True))
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, v int, runs string")
    for hot in (512, 3):
        monkeypatch.setattr(suffixes, "HOT", hot)
        assert sorted((r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeats(df).collect()) == want
    assert dict(want)[7] or sum(i == 7 for i, _ in want) == 2


def test_suffix_family_levels():
    g = np.random.default_rng(3)
    n, width, key = 300, 24, 8
    side = width - key
    seg = [bytes(x) for x in g.integers(97, 99, (n, side + key + side)).astype(np.uint8)]
    k, a, lo, hi = g.integers(0, 3, n), np.full(n, side), np.zeros(n, int), np.full(n, side)
    hits = []
    for batch in (n, 37):
        hit, fam = suffixes.matched(k, a, lo, hi, seg, side, key, batch)
        hits.append(hit)
        assert fam.merges == -(-n // batch) - 1
    assert (hits[0] == hits[1]).all() and hits[0].any()
    assert fam.between > 0  # merges of levels find windows, not only the scans inside batches
    for w in (0, 5, side):
        code = Counter((k[i], seg[i][side - w : side], seg[i][side + key : side + key + side - w]) for i in range(n))
        assert [bool(x) for x in hits[0][:, w]] == [code[k[i], seg[i][side - w : side], seg[i][side + key : side + key + side - w]] > 1 for i in range(n)]


def test_merged_levels_stay_sorted():
    g = np.random.default_rng(4)
    make = lambda n: suffixes.Level(g.integers(0, 3, (n, 20)).astype(np.uint8), g.integers(0, 3, (n, 20)).astype(np.uint8), np.zeros(n, int), np.zeros(n, int), np.arange(n))
    m = suffixes.merge(make(40), make(25))
    for ctx, order in ((m.right, m.sa), (m.left, m.rsa)):
        rows = [bytes(ctx[i]) for i in order]
        assert rows == sorted(rows) and sorted(order) == list(range(65))
    assert m.second.sum() == 25


def test_suffix_index_of_batches(spark, tmp_path):
    """Batches find what they share with earlier ones; sizes double."""
    g = random.Random(21)
    make = lambda n: "".join(g.choice("abcdefg ") for _ in range(n))
    shared = make(260)
    index = suffixes.SuffixIndex(str(tmp_path / "levels"))
    rows, got = [], {}
    for b in range(4):
        batch = [(b * 10 + i, make(300) + (shared if i == 1 and b != 2 else "") + make(100)) for i in range(3)]
        rows += batch
        for r in index.add(spark.createDataFrame(batch, "doc_id long, text string")).collect():
            got.setdefault(r["doc_id"], set()).update(range(r["lo"], r["hi"] + 200))
        assert sorted(index.levels) == [[1], [2], [1, 2], [4]][b]
    assert index.merges == 3
    assert [len(got.get(i, ())) for i, _ in rows] == repeats_by_brute_force(rows, 200) and got


def test_odd_sketches_bound_differences():
    rng = np.random.default_rng(5)
    for n, m, both in [(0, 0, 0), (1, 1, 0), (1, 1, 1), (40, 50, 40), (300, 420, 290), (1000, 1030, 900), (7, 5000, 3)]:
        every = rng.choice(1 << 62, n + m - both, replace=False).astype(np.uint64)
        x, y = every[:n], every[n - both :]
        sketch = jaccard.sketches(np.concatenate([x, y]), np.array([0, n, n + m])).to_pylist()
        assert jaccard.apart(*sketch) <= n + m - 2 * both
        assert jaccard.apart(sketch[0], sketch[0]) == 0
        assert jaccard.apart(*sketch) == jaccard.apart(*reversed(sketch))
        assert n != m or both or not n or jaccard.apart(*sketch) > 0


def test_jaccard(docs, monkeypatch):
    s = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in rows_of(docs).items()}
    up = {i: i for i in s}
    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = find(up, i), find(up, j)
                up[max(a, b)] = min(a, b)
    want = {i: (len(s[i]), find(up, i)) for i in s}
    for pairwise, part in ((6, 256), (2, 4)):
        monkeypatch.setattr(jaccard, "PAIRWISE", pairwise)
        monkeypatch.setattr(jaccard, "PART", part)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()} == want


def test_jaccard_of_shared_ids(spark):
    """Rows with one doc_id and different texts are linked by their own texts; of each group one row stays."""
    g = random.Random(3)
    make = lambda n: " ".join(f"w{g.randrange(500)}" for _ in range(n))
    a, b = make(60), make(60)
    rows = [(1, a), (1, b), (2, b + " x"), (3, a + " y"), (3, a + " y"), (4, ""), (4, None), (None, a), (5, make(50))]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_rows int, spans string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    left = jaccard.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, ""), (4, None), (None, a), rows[-1]], key=str)
    # exact copies of one row
    twice = spark.createDataFrame([(7, a), (7, a), (8, a)], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in jaccard.drop_near_duplicates(twice).collect()] == [(7, a)]


def test_family_answers_from_a_similar_set():
    """Overlaps of a family derived from one set's overlaps and the differences to it, against counting."""
    g = np.random.default_rng(6)
    base = g.choice(10_000, 200, replace=False)
    sets = [np.unique(np.concatenate([g.permutation(base)[: 200 - k], g.choice(10_000, k) + 20_000])).astype(np.uint64) for k in (0, 3, 9, 40, 120)] + [np.array([5], np.uint64), np.arange(30_000, 30_060).astype(np.uint64)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert jaccard.overlaps(sets, columns=17).tolist() == want


def test_katz(docs):
    w = {i: [*words(t), None] for i, t in rows_of(docs).items()}
    train = {i for i in w if zlib.crc32(str(i).encode()) % 5 != 1}
    uni, bi = Counter(), Counter()
    for i in train:
        uni.update(w[i])
        bi.update(zip(["<s>", *w[i]], w[i], strict=False))
    n, v = sum(uni.values()), len(uni)
    low = lambda c: {-1: sum(c.values()), 0: len(c)} | Counter(x for x in c.values() if x <= katz.RELIABLE + 1)
    p1, d2 = katz.Unigram(low(uni)), katz.discounts(low(bi), katz.CUTOFF)
    hist = Counter(uni)
    hist["<s>"] = len(train)
    known = {}
    for (h, x), c in bi.items():
        if c >= katz.CUTOFF:
            known.setdefault(h, {})[x] = float(katz.mass(np.array([c]), d2)[0]) / hist[h]
    one = lambda x: float(p1(np.array([uni[x]]))[0])
    assert sum(one(x) for x in uni) + float(p1(np.array([0]))[0]) == pytest.approx(1)

    def prob(h, x):
        k = known.get(h, {})
        if x in k:
            return k[x]
        return (1 - sum(k.values())) / (1 - sum(one(y) for y in k)) * one(x)

    h = max(known, key=lambda k: len(known[k]))
    assert sum(prob(h, x) for x in uni) + prob(h, "unknown") == pytest.approx(1)
    got = {r["doc_id"]: r for r in katz.score_texts(docs).collect()}
    assert set(got) == set(w)
    for i, x in w.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(uni[y] > 0 for y in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[y] + 0.5) / (n + 0.5 * (v + 1))) for y in x))
        assert r["score"] == pytest.approx(sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *x], x, strict=False)))


def window_hits(rows, items):
    """n_hit and the items of each row, by brute force: A-Z lowered, words of letters, digits and all that is not ASCII."""
    cut = lambda t: [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(TR)) if w]
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for k, x in items:
            x = cut(x)
            n = min(10, len(x))
            for g in {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == g:
                        hit |= set(range(s, s + n))
                        found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate(spark, docs, monkeypatch):
    t = rows_of(docs)
    bench = spark.createDataFrame([(0, " ".join((t[3] or "").split()[2:14])), (10, "ein"), (2, None), (3, ""), (4, "Same, same"), (5, t[5]), (6, t[5])], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    b = con.execute(decontaminate.SQL["op5_decontaminate"]).df()
    for rows in (1_000_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        a = decontaminate.contamination(docs, bench).toPandas()
        a, c = (x[sorted(x)].sort_values("doc_id").reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, c, check_dtype=False)
        assert a.contaminated.sum() >= 3
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_decontaminate_odd_rows(spark):
    """Words that lose their last sigma when a whole text is lowered, shared and missing ids, a window of very many items."""
    greek = " ".join(f"Α{x}Σ.{x}Δ ÄB" for x in "αβγδε")
    line = "one two three four five six seven eight nine TEN"
    items = [(1, greek), (2, "short Item"), (None, "no id"), (3, "")] + [(100 + i, f"{line} own{i} words{i}") for i in range(300)]
    rows = [(1, greek), (2, "x " + greek.lower() + " y"), (3, f"before {line.upper()} after"), (4, line), (4, "nothing to see"), (4, "a short item"), (5, None), (6, ""), (None, line), (4, line)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, words string, n int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, size string")
    want = sorted(window_hits([r for r in rows if r[0] is not None], [x for x in items if x[0] is not None]))
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == want
    assert dict((x[0], x[2]) for x in want)[1] == 15
    left = sorted(((r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(docs, bench).collect()), key=str)
    assert left == sorted([rows[1], (4, "nothing to see"), (5, None), (6, ""), (None, line)], key=str)


def test_chaining(docs):
    t = {i: words(x) for i, x in rows_of(docs).items()}
    first, need = {}, set()
    for i in sorted(t):
        mine = {tuple(t[i][k : k + 51]) for k in range(len(t[i]) - 50)}
        if any(x in first for x in mine):
            need.add(i)
        for x in mine:
            first.setdefault(x, i)
    got = chaining.passages(docs).collect()
    assert need <= {r["doc_id"] for r in got}
    for r in got:
        assert r["source_id"] < r["doc_id"] and r["length"] >= chaining.LEAST and r["start"] + r["length"] <= len(t[r["doc_id"]])
    cut = {r["doc_id"]: r for r in chaining.cut_passages(docs, chaining.passages(docs).select("doc_id", "start", "length")).collect()}
    hit = {r["doc_id"] for r in got}
    before = rows_of(docs)
    assert all(cut[i]["text"] == before[i] for i in before if i not in hit)


def test_chain_takes_the_collinear_links():
    x, y = [0, 5, 10, 15, 7], [100, 105, 110, 115, 3]
    assert chaining.chain(x, y)[0] == [0, 1, 2, 3]


def test_chain_is_not_hidden_by_a_stray():
    body = list(range(100, 400, 10))
    for stray in ([0], [0, 5]):
        x = stray + body
        assert chaining.chain(x, x)[0] == list(range(len(stray), len(x)))
        assert chaining.chain(x, [v + (20 if v >= 100 else 0) for v in x])[0] == list(range(len(stray), len(x)))
    # a short chain that scores more than a longer one with drift
    assert chaining.chain([0, 5, 100, 106], [0, 5, 200, 220]) == [[2, 3]]
    x, y = [0, 5, *range(60, 300, 12)], [0, 5, *range(60, 300, 12)]
    assert [x[i] for i in chaining.chain(x, y)[0]] == x[2:]


def test_blocks_inside_passages(spark):
    """Two exact halves around a block of other words are found whole, whether the block is inserted, replaced or cut out."""
    rows, halves = [], {}
    for half in (60, 100):
        for n in (9, 20, 25, 32, 40):
            for kind in ("insert", "replace", "cut"):
                i = len(rows)
                w = lambda k, m: [f"{k}{i}x{j}" for j in range(m)]  # noqa: B023, E731
                a, b, other, own = w("a", half), w("b", half), w("o", n), w("p", n)
                source = a + b if kind == "insert" else a + own + b
                rows += [(i, " ".join(source)), (i + 1, " ".join(a + b if kind == "cut" else a + other + b))]
                shift = 0 if kind == "cut" else n
                halves[i + 1] = (half, half + shift)
    got = {}
    for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
    for i, (half, second) in halves.items():
        assert {*range(half), *range(second, second + half)} <= got.get(i, set()), rows[i]


def test_stolen_seeds(spark):
    """Exact passages of 51 to 62 words of which earlier documents hold all pieces are found, against brute force."""
    g, rows = random.Random(8), []
    own = lambda n: [f"u{len(rows)}x{g.random()}" for _ in range(n)]
    for k in range(51, 63):
        p = own(k)
        for middle in ((1, k - 1), (5, 54), (0, 49), (k - 49, k)) if k % 2 else ((0, 49), (k - 49, k), (6, 54)):
            rows.append((len(rows), " ".join(own(8) + p[slice(*middle)][:49] + own(8))))
        rows += [(len(rows) + i, " ".join(own(n) + p + own(9))) for i, n in enumerate((3, 17))]
    a, b, c = own(48), own(47), own(49)
    for line in (a, b, c):
        rows.append((len(rows), " ".join(own(5) + line + own(5))))
    rows += [(len(rows) + i, " ".join(own(n) + a + b + c + own(4))) for i, n in enumerate((4, 11))]
    t, first, need = {i: x.split() for i, x in rows}, {}, {}
    for i in sorted(t):
        for k in range(len(t[i]) - 50):
            if first.setdefault(tuple(t[i][k : k + 51]), i) != i:
                need.setdefault(i, set()).update(range(k, k + 51))
    got = {}
    for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
        assert r["source_id"] < r["doc_id"] and r["start"] >= 0 and r["source_start"] >= 0
    assert len(need) == 13
    for i in need:
        assert need[i] <= got.get(i, set()), i


def test_chain_scores_against_brute_force():
    """The best chain's score is that of the best of all orders of links, by trying every predecessor."""
    g = random.Random(17)
    for _ in range(60):
        n = g.randint(2, 14)
        x, y = sorted(g.sample(range(60), n)), [g.randrange(60) for _ in range(n)]
        score = []
        for i in range(n):
            score.append(chaining.K + max([0.0] + [score[j] - chaining.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]))
        got = chaining.chain(x, y)
        total = lambda c: len(c) * chaining.K - chaining.GAP * sum(x[q] - x[p] + y[q] - y[p] for p, q in zip(c, c[1:], strict=False))  # noqa: B023, E731
        for c in got:
            assert all(x[p] < x[q] and y[p] < y[q] for p, q in zip(c, c[1:], strict=False)) and x[c[-1]] - x[c[0]] + chaining.K >= chaining.LEAST_SEED
        assert len({i for c in got for i in c}) == sum(map(len, got))
        if got and max(b - a for a, b in zip(x, x[1:], strict=False)) <= chaining.MOST_GAP:
            assert total(got[0]) <= max(score) + 1e-9
            if x[got[0][-1]] - x[got[0][0]] > 30:
                assert total(got[0]) == pytest.approx(max(score))


def test_recall_of_fuzzy_passages(spark):
    """Passages of 120 words with words changed at random, and regular changes: how many are found, and how much of them."""
    g, rows, want = random.Random(9), [], {}
    own = lambda n: [f"u{g.getrandbits(40):x}" for _ in range(n)]
    for rate in (3, 6, 10, 15):
        for _ in range(40):
            p = own(120)
            q = [w if g.random() >= rate / 100 else own(1)[0] for w in p]
            rows.append((len(rows), " ".join(own(40) + p + own(40))))
            want[len(rows)] = (rate, 30)
            rows.append((len(rows), " ".join(own(30) + q + own(50))))
    w = own(200)
    for name, q in (("ninth", [x if k % 9 else own(1)[0] for k, x in enumerate(w)]), ("deleted", [x for k, x in enumerate(w) if k % 10])):
        rows.append((len(rows), " ".join(w)))
        want[len(rows)] = (name, 0)
        rows.append((len(rows), " ".join(q)))
        w = own(200)
    got = {}
    for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
    by = {}
    for i, (rate, start) in want.items():
        n = 120 if isinstance(rate, int) else len(rows[i][1].split())
        by.setdefault(rate, []).append(len(got.get(i, set()) & set(range(start, start + n))) / n)
    found = {k: np.mean([x > 0 for x in v]) for k, v in by.items()}
    covered = {k: np.mean(v) for k, v in by.items()}
    print(found, covered)
    assert all(found[k] >= 0.9 and covered[k] >= 0.8 for k in by), (found, covered)


@pytest.mark.parametrize("change", [0.03, 0.05, 0.1])
def test_passages_beside_a_holder_of_pieces(spark, change):
    """A passage of two documents is found though an earlier one, and one between them, hold its words in pieces that are short and in another order; and its words are covered as without them."""
    g = random.Random(12)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(3, 8)))
    covered = {}
    for others in (False, True):
        g.seed(12)
        rows, where = [], {}
        for k in range(12):
            passage = [word() for _ in range(160)]
            changed = [word() if g.random() < change else w for w in passage]
            pieces = lambda n: [w for p in range(160 - n, -1, -n) for w in passage[p : p + n]]
            first, between = pieces(32), pieces(20)
            noise = lambda: [word() for _ in range(80)]
            texts = {4 * k: first if others else noise(), 4 * k + 1: noise() + passage + noise(), 4 * k + 2: between if others else noise(), 4 * k + 3: noise() + changed + noise()}
            where[4 * k + 3] = 4 * k + 1
            rows += [(i, " ".join(t)) for i, t in texts.items()]
        got = {}
        for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
            if where.get(r["doc_id"]) == r["source_id"]:
                got.setdefault(r["doc_id"], set()).update(range(max(r["start"], 80), min(r["start"] + r["length"], 240)))
        assert len(got) == 12
        covered[others] = np.mean([len(v) / 160 for v in got.values()])
    assert covered[True] > 0.9 and covered[True] > covered[False] - 0.03, covered


def test_links_to_the_document_before():
    """Runs of equal keys and documents, cut into batches anywhere, against a plain loop."""
    g = np.random.default_rng(9)
    rows = sorted({(int(f), int(d), int(x)) for f, d, x in zip(g.integers(0, 6, 200), g.integers(0, 9, 200), g.integers(0, 5, 200), strict=True)})
    heads = {}
    for f, d, x in rows:
        heads.setdefault(f, (d, x))
    want = []
    for f, d, x in rows:
        before = [r for r in rows if r[0] == f and r[1] < d]
        if d != heads[f][0]:
            want.append((d, heads[f][0], x, heads[f][1]))
            if before[-1][1] != heads[f][0]:
                want.append((d, before[-1][1], x, before[-1][2]))
    for size in (1, 2, 7, 300):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [chaining._batch(f=np.array([r[0] for r in c]), doc_id=np.array([r[1] for r in c]), x=np.array([r[2] for r in c]), source_id=np.array([heads[r[0]][0] for r in c]), y=np.array([heads[r[0]][1] for r in c])) for c in cut]
        got = [tuple(r.values()) for b in chaining._with_previous(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)


def test_pack(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t = rows_of(docs)
    ids = {i: [*tok.encode(x or "", add_special_tokens=False).ids, 1] for i, x in t.items()}
    out = [r for r in pack.pack_documents(docs).collect() if r["doc_id"] is not None]
    for i, want in ids.items():
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], np.uint32).tobytes())
            at += r["length"]
        assert at == len(want)
    for s in {r["sequence_id"] for r in pack.pack_documents(docs).collect()}:
        own = sorted((r for r in pack_rows(docs) if r["sequence_id"] == s), key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= pack.TOP and at & (at - 1) == 0


_ROWS = {}


def pack_rows(docs):
    return _ROWS.setdefault(id(docs), pack.pack_documents(docs).collect())


def test_cover_tree(spark, monkeypatch):
    g = np.random.default_rng(4)
    base = g.normal(size=(40, 8))
    x = np.concatenate([base, base[:20] + g.normal(scale=0.15, size=(20, 8)), base[:3], 5 * base[:3]])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0] * 7 + [None]), (104, []), (105, [1.0, 2.0]), (106, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    for block, leaf in ((4096, 64), (8, 2)):
        monkeypatch.setattr(covertree, "BLOCK", block)
        monkeypatch.setattr(covertree, "LEAF", leaf)
        got = {r["vec_id"]: r for r in covertree.near_duplicates(df).collect()}
        assert len(got) == len(rows)
        assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(100, 105))
        assert got[105]["n_links"] == 1 and got[106]["component_id"] == 105
        up = {i: i for i in range(len(x))}
        for i, j in zip(*np.nonzero(link), strict=True):
            a, b = find(up, i), find(up, j)
            up[max(a, b)] = min(a, b)
        assert [got[i]["component_id"] for i in range(len(x))] == [find(up, i) for i in range(len(x))]


def test_cover_tree_ties(spark):
    """Pairs at a cosine of exactly 0.9, in whole numbers: they link, also when scaled; those a little below do not."""
    whole = [v for v in np.ndindex(10, 5, 4, 3) if any(v) and math.gcd(*v) == 1]
    whole = list(dict.fromkeys(whole))
    x = np.array(whole, np.int64)
    dot, n = x @ x.T, (x * x).sum(1)
    link = (dot > 0) & (100 * dot * dot >= 81 * np.outer(n, n)) & ~np.eye(len(x), dtype=bool)
    tied = (100 * dot * dot == 81 * np.outer(n, n)).sum()
    assert tied > 40
    rows = [(i, [float(a) * (1.0, 3.0, 1e-160, 1e140)[i % 4 if i % 8 > 3 else 0] for a in v]) for i, v in enumerate(whole)]
    exact = [i for i in range(len(rows)) if i % 8 <= 3]  # those of whole numbers; the others' products round
    got = {r["vec_id"]: r["n_links"] for r in covertree.near_duplicates(spark.createDataFrame([rows[i] for i in exact], "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in exact] == link[np.ix_(exact, exact)].sum(1).tolist()
    both = {r["vec_id"]: r["n_links"] for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    loose = (dot > 0) & (100 * dot * dot != 81 * np.outer(n, n)) & link
    assert all(loose[i].sum() <= both[i] <= link[i].sum() for i in range(len(rows)))


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op7_language_mixture(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 — !!"), (4, "the and of that with")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(odd, *langid.learn(docs)).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en"


def test_mixture_against_plain_em():
    """Proportions, likelihoods and the chosen language set, computed document by document."""
    g = np.random.default_rng(12)
    sizes, k = [0, 1, 5, 40], 4
    bound = np.concatenate([[0], np.cumsum(sizes)])
    like = g.random((bound[-1], k)) ** 4
    like[6:26, 0], like[26:, 2] = 1.0, 1.0  # words of two languages

    def em(rows, allowed):
        share = np.array([1.0 if j in allowed else 0.0 for j in range(k)]) / len(allowed)
        for r in range(langid.ROUNDS):
            total, ll = np.zeros(k), 0.0
            for w in rows:
                z = float((share * w).sum())
                ll += math.log(max(z, 1e-300))
                total += share * w / max(z, 1e-300)
            if r < langid.ROUNDS - 1 and len(rows):
                share = total / len(rows)
        return share, ll

    got = langid.infer(like, np.ones(len(like)), bound)
    for d, n in enumerate(sizes):
        if not n:
            continue
        rows = like[bound[d] : bound[d + 1]]
        full, ll = em(rows, range(k))
        order = np.argsort(-full, kind="stable")
        best = (ll - langid.PENALTY * (k - 1) * math.log(max(n, 2)), full)
        for m in (1, 2, 3):
            s, l = em(rows, order[:m]) if m > 1 else (np.eye(k)[order[0]], sum(math.log(max(w[order[0]], 1e-300)) for w in rows))
            if l - langid.PENALTY * (m - 1) * math.log(max(n, 2)) >= best[0]:
                best = (l - langid.PENALTY * (m - 1) * math.log(max(n, 2)), s)
        assert got[d] == pytest.approx(best[1], abs=1e-9), d


def test_languages_of_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    two = docs.where("lang = 'de' and length(text) > 400").first()["text"][:400] + " " + docs.where("lang = 'en' and length(text) > 400").first()["text"][:400]
    rows = [(1, two), (1, two), (2, "x" * 300_000), (None, "the and of"), (3, None)]
    odd = spark.createDataFrame([(i, t, "en", 3.0) for i, t in rows], "doc_id long, text string, lang_pred string, shares double")
    got = langid.identify_languages(odd, *model).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2, 3]
    share = dict(zip(model[0], next(r["shares"] for r in got if r["doc_id"] == 1), strict=True))
    assert share["de"] > 0.2 and share["en"] > 0.2 and sum(share.values()) == pytest.approx(1)
    assert langid.identify_languages(odd.limit(0), *model).count() == 0
    none = langid.identify_languages(odd, *langid.learn(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and {r["score"] for r in none} == {0.0}


def test_viterbi_against_all_readings():
    """The decoded word is the likeliest of all readings of a token."""
    import itertools

    g = random.Random(2)
    model = toxicity.CharModel(toxicity.CharModel.count({"idiot": 40, "ball": 9, "tall": 5, "stupid": 30, "good": 12, "loot": 4}))

    def weight(word):
        codes = [26, 26, *(ord(x) - 97 for x in word), 26]
        return sum(model.log[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    for _ in range(80):
        token = "".join(g.choice("idot10!s5ub|la4") for _ in range(g.randint(2, 6)))
        runs = [(c, len(list(n))) for c, n in itertools.groupby(token)]
        options = []
        for c, n in runs:
            letters = toxicity.LOOKALIKES.get(c, c if c.isalpha() else "")
            options.append([x * k for x in letters for k in ((1,) if n < 2 else (1, 2))])
        best = max((weight("".join(o)) for o in itertools.product(*[o for o in options if o])), default=None)
        got = model.decode(token)
        assert best is None or weight(got) == pytest.approx(best), token
    # no token is too long, or has too many digits
    assert [len(w) for w in toxicity.restored("1d10t5 " + "x1" * 90, model, {})] == [6, 180]


def test_toxicity_of_odd_rows(spark):
    sf = "/root/testdata/sf0.1"
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(1, "you 1d10t"), (1, "you 1d10t"), (1, "a fine day"), (None, "you idiot"), (2, None), (3, "(" * 50_000 + " " + "1" * 50_000), (4, "you 1d10" + "t" * 60), (5, "word " * 100_000 + "1d10t")]
    odd = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, source string")
    got = sorted((r["doc_id"], r["score"] >= toxicity.THRESHOLD) for r in toxicity.score_toxicity(odd, *model).collect())
    assert got == [(1, False), (1, True), (1, True), (2, False), (3, False), (4, True), (5, True)]
    left = toxicity.drop_toxic(odd, *model)
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3]
    assert toxicity.score_toxicity(odd.limit(0), *model).count() == 0


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = out[out.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.9 and (out[out.toxic == 1].predicted == 1).mean() > 0.6
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you are an 1d10t"), (4, "you i d i o t"), (5, "what a ball is tall")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, *model).collect()}
    assert got[3] >= 0.7 and got[4] >= 0.7 and max(got[1], got[2], got[5]) < 0.7
    assert {r["doc_id"] for r in toxicity.drop_toxic(odd, *model).collect()} == {1, 2, 5}
    assert toxicity.score_toxicity(odd, *toxicity.learn(docs, labels.limit(0))).where("score >= 0.7").count() == 0


RARE = ["gormless", "wretch", "numpty", "pillock", "blighter", "scoundrel", "muppet", "twerp"]


def many_labelled_rows():
    """More rows than any sample: words of 14,000 toxic rows, of 5 others each (RARE), and of 9 toxic and 5 clean ones."""
    texts = ["a vile thing"] * 14_000 + [f"{w}" for w in RARE for _ in range(5)] + ["oh muddled one"] * 14 + ["a fine thing"] * 1446
    ids = (i for i in range(99_999) if zlib.crc32(str(i).encode()) % 3 != 1)
    return [(i, t, int(k < 14_049)) for k, (i, t) in enumerate(zip(ids, texts, strict=False))]


def test_toxicity_learns_from_all_rows(spark):
    rows = many_labelled_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-7, "unlabelled gormless")], "doc_id long, text string").repartition(3)
    weights, counts, base = toxicity.learn(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    assert sorted(weights.values()) == [5 / 6] * len(RARE) + [14_000 / 14_001] and base == 14_049 / 15_500
    assert (counts == toxicity.CharModel.count(Counter(w for _, t, _ in rows for w in t.split() if len(w) > 2))).all()
    got = [r["score"] >= toxicity.THRESHOLD for r in toxicity.score_toxicity(spark.createDataFrame([*enumerate(["vile", "muddled", *RARE])], "doc_id long, text string").coalesce(1), weights, counts, base).orderBy("doc_id").collect()]
    assert got == [True, False] + [True] * len(RARE)


def test_lexicon_is_greedy(spark, monkeypatch):
    """The rounds on tables and the driver's choice against the plain greedy one, whose lexicon has no set size."""
    g = random.Random(8)
    p, n = {f: g.randint(40, 60) for f in range(700)}, {f: g.randint(0, 4) for f in range(700)}
    has = {(d, f) for f in range(700) for d in ([9000 + 3 * f, 9001 + 3 * f, 9002 + 3 * f] if f % 3 else g.choices(range(60), k=g.randint(1, 12)))}
    left, want = {d: {f for e, f in has if e == d} for d in {d for d, _ in has}}, {}
    while True:
        gain = Counter(f for fs in left.values() for f in fs)
        f = max(gain, key=lambda f: (gain[f] * (p[f] / (p[f] + n[f])), -f), default=None)
        if f is None or gain[f] * (p[f] / (p[f] + n[f])) < toxicity.GAIN * toxicity.PRECISION:
            break
        want[f] = p[f] / (p[f] + n[f] + 1)
        left = {d: fs for d, fs in left.items() if f not in fs}
    pairs = spark.createDataFrame([(d, f, p[f], n[f]) for d, f in has], "doc_id long, f long, p long, n long")
    assert len(want) > 400
    assert toxicity.cover(pairs) == want
    monkeypatch.setattr(toxicity, "PAIRS", 0)
    assert toxicity.cover(pairs) == want


def test_toxicity_of_spaced_and_long_tokens(spark):
    sf = "/root/testdata/sf0.1"
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    bad = ["you are a i d i o t", "you a.i.d.i.o.t", "you i" + "d" * 50 + "iot", "what a i d i o t you are", "you are an i d i o t s o b e it"]
    odd = spark.createDataFrame(list(enumerate([*bad, "plan a b c d of the ball", "a " + "l" * 50])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, *model).collect()}
    assert [got[i] >= toxicity.THRESHOLD for i in range(len(got))] == [True] * len(bad) + [False] * 2


def licenses_by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted(map(tuple, con.execute(licenses.SQL["op10_license_sentences"]).df()[["doc_id", "license_id", "n_matches", "first_sentence", "last_sentence"]].values.tolist()))


def licenses_of(docs):
    return sorted((r["doc_id"], r["license_id"], r["n_matches"], r["first_sentence"], r["last_sentence"]) for r in licenses.scan_licenses(docs).collect())


def test_licenses(spark):
    t = ["A. Released under the MIT License.\nB", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", None, "", "license"]
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = licenses_of(docs)
    assert got == licenses_by_sql(docs)
    assert [x[:2] for x in got] == [(0, "MIT"), (1, "MIT")]


def test_licenses_of_odd_rows(spark):
    """Repeated rows, shared and missing ids, ties, long texts, clashing columns, lines of one character."""
    mit = "Released under the MIT License."
    rows = [(1, mit), (1, mit), (1, f"{mit} {mit}"), (2, "word " * 60_000 + f"\n{mit}\n" + "word " * 60_000), (None, mit), (3, f"a\nb\nc\n\nd\n{mit.upper()}\r\ne"), (4, "SPDX-License-Identifier: MIT\n# SPDX-License-Identifier:  BSD-3-Clause\nx"), (5, "mit\nmit license"), (6, "\nReleased\nunder\nthe\n MIT\n License\n"), (7, "Neither  the name of the X\nmit dem Haus")]
    docs = spark.createDataFrame([(i, t, "p", 3, "k") for i, t in rows], "doc_id long, text string, p string, n int, license_id string")
    got = licenses_of(docs)
    assert got == licenses_by_sql(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [x[:3] for x in got] == [(1, "MIT", 1), (1, "MIT", 2), (2, "MIT", 1), (3, "MIT", 1), (4, "BSD-3-Clause", 1), (4, "MIT", 1), (6, "MIT", 1)]
    assert licenses_of(docs.limit(0)) == []


def test_licenses_of_notices(spark):
    """Notices as the licences' authors publish them, wrapped as in files."""
    fsf = "This {0} is free software: you can redistribute it and/or modify it\nunder the terms of the GNU {1}General Public License as published by the\nFree Software Foundation, either version {2} of the License, or (at your option)\nany later version.\n"
    t = {
        "GPL-3.0": fsf.format("program", "", 3), "GPL-2.0": fsf.format("program", "", 2), "LGPL-2.1": fsf.format("library", "Lesser ", "2.1"), "AGPL-3.0": fsf.format("program", "Affero ", 3), "LGPL-3.0": fsf.format("library", "Lesser ", 3),
        "ISC": "ISC License\n\nCopyright X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this",
        "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at",
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy",
        "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/",
        "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding",
    }
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(t.values())], "doc_id long, text string")
    got = licenses_of(docs)
    assert [x[:2] for x in got] == list(enumerate(t))
    assert got == licenses_by_sql(docs)
    tables = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert licenses_of(tables) == licenses_by_sql(tables)


def test_license_lines_of_the_tables(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {(r["doc_id"], lines[x]) for r in docs.collect() for x in lines if x in (r["text"] or "")}
    assert {x for _, x in want} == set(lines.values())
    assert {(r["doc_id"], r["license_id"]) for r in licenses.scan_licenses(docs).collect()} == want


def test_wrapped_licenses(spark):
    mit = "MIT License\n\nCopyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions.\n\n3. Neither the name of X\n"
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY"
    x = "X is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License. This program is distributed in the hope that it will be useful."
    t = [mit, bsd, apache, gpl, x, apache.split("You may obtain")[1], mit.replace("\n", "\r\n"), "\n".join(" * " + y for y in gpl.split("\n")), "of this software\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software"]
    want = [{"MIT"}, {"BSD-3-Clause"}, {"Apache-2.0"}, {"GPL"}, {"GPL"}, set(), {"MIT"}, {"GPL"}, set()]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license_id"])
    assert [got.get(i, set()) for i in range(len(t))] == want


def test_licenses_by_hand(spark):
    """Texts and what is to be found in them, written out: identifiers of all kinds, and a short rule inside a longer one."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions.\n"
    names = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products.\n"
    spdx = {
        "GPL-2.0": "GPL-2.0", "GPL-2.0+": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-2.0 WITH Linux-syscall-note": "GPL-2.0", "GPL-3.0+": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-2.1+": "LGPL-2.1", "LGPL-2.1": "LGPL-2.1",
        "LGPL-2.0-or-later": "LGPL-2.0", "LGPL-3.0-only": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0": "AGPL-3.0", "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0", "BSL-1.0": "BSL-1.0",
        "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0", "Artistic-2.0": "Artistic-2.0", "Zlib": "Zlib", "0BSD": "0BSD", "WTFPL": "WTFPL", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "MS-PL": "MS-PL", "PostgreSQL": "PostgreSQL", "OFL-1.1": "OFL-1.1", "EUPL-1.2": "EUPL-1.2", "Apache-2.0 WITH LLVM-exception": "Apache-2.0",
    }
    t = [(f"// SPDX-License-Identifier: {k}\nint x;", {v}) for k, v in spdx.items()]
    t += [("# SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}), ("/* SPDX-License-Identifier: (GPL-2.0 OR MIT) */", {"GPL-2.0", "MIT"}), ("SPDX-License-Identifier: GPL-2.0 OR BSD-3-Clause", {"GPL-2.0", "BSD-3-Clause"}), ("SPDX-License-Identifier: LicenseRef-Own", set())]
    t += [(bsd, {"BSD-2-Clause"}), (bsd + names, {"BSD-3-Clause"}), (bsd + names + "\n\n" + bsd, {"BSD-2-Clause", "BSD-3-Clause"}), (bsd + "\n" + bsd + names, {"BSD-2-Clause", "BSD-3-Clause"})]
    t += [("The Artistic License 2.0\n\nCopyright", {"Artistic-2.0"}), ("you can redistribute it and/or modify it under\nthe same terms as Perl itself.", {"Artistic-1.0-Perl"}), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", {"OFL-1.1"}), ("As long as you retain this notice you\ncan do whatever you want with this stuff.", {"Beerware"})]
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(t)], "doc_id long, text string")
    got = {}
    for r in licenses.scan_licenses(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license_id"])
    assert [(x, got.get(i, set())) for i, (x, _) in enumerate(t)] == t
    assert licenses_of(docs) == licenses_by_sql(docs)
    assert len({r for r, _ in licenses.RULES}) >= 32


def test_katz_keeps_bigrams_seen_once(spark):
    """Singletons are discounted by n2 / n1, with the formula written out."""
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1]
    t = {i: f"a b c{k % 9} d{k % 5} e{k}" for k, i in enumerate(train)}
    bi = Counter(b for x in t.values() for b in zip(["<s>", *x.split()], [*x.split(), "</s>"], strict=True))
    n = Counter(bi.values())
    common = 8 * n[8] / n[1]
    d1 = (2 * n[2] / n[1] - common) / (1 - common)
    d1 = d1 if 0.1 < d1 < 1 else 0.5
    once = [b for b in bi if bi[b] == 1 and b[1].startswith("e")]
    assert once and katz.discounts(dict(n), katz.CUTOFF)[1] == pytest.approx(d1)
    got = {r["doc_id"]: r["score"] for r in katz.score_texts(spark.createDataFrame(list(t.items()), "doc_id long, text string")).collect()}
    hist = Counter(w for x in t.values() for w in x.split())
    disc = lambda c: 1 if c > 7 else katz.discounts(dict(n), 1)[c]
    seen = lambda a, b: bi[a, b] * disc(bi[a, b]) / (len(t) if a == "<s>" else hist[a])
    for i, x in t.items():
        assert got[i] == pytest.approx(sum(math.log10(seen(*b)) for b in zip(["<s>", *x.split()], [*x.split(), "</s>"], strict=True)))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (suffixes.remove_repeats, jaccard.jaccard_components, katz.score_texts, chaining.passages, pack.pack_documents, licenses.scan_licenses):
        assert f(none).count() == 0, f
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_pipeline_drops_what_few_labelled_rows_teach(spark, tmp_path):
    """The toxicity stage learns from all labelled rows of the documents that it is given."""
    import corpus_pipeline as p

    rows = many_labelled_rows()
    spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(None, f"so {w}", 2) for w in RARE] + [(None, "so fine", 3), (-7, "gormless", 4)], "doc_id long, text string, k int").repartition(3)
    left = p.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(left.groupBy("k", "text").count().collect()) == [(1, "a fine thing", 1446), (1, "oh muddled one", 14), (3, "so fine", 1)]


def test_pipeline_learns_from_every_third(spark, tmp_path):
    """The toxicity stage learns from labels of op8's held-out third too; op8 itself does not."""
    import corpus_pipeline as p

    ids = {k: [i for i in range(999) if (zlib.crc32(str(i).encode()) % 3 == 1) == k] for k in (True, False)}
    rows = [(i, t, x) for k, word in ((True, "gormless"), (False, "wretched")) for i, (t, x) in zip(ids[k], [(f"{word} {word}", 1)] * 9 + [("a fine thing", 0)] * 20, strict=False)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-7, "so gormless"), (-8, "so wretched"), (-9, "so fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    left = p.drop_toxic(spark, docs, str(tmp_path))
    assert sorted(left.groupBy("text").count().collect()) == [("a fine thing", 40), ("so fine", 1)]
    weights, counts, base = toxicity.learn(docs, labels)
    assert sorted(weights.values()) == [9 / 10] * 2 and base == 18 / 58
    assert (counts == toxicity.CharModel.count(Counter(w for _, t, _ in rows for w in t.split() if len(w) > 2))).all()
    got = toxicity.op8_toxicity(spark, str(tmp_path))
    assert {r["text"] for r in got.where("predicted = 1").join(docs, "doc_id").collect()} == {"wretched wretched", "so wretched"}


def test_pipeline(spark):
    """Each stage on what the one before kept, against brute force (the toxicity stage: against the operator's scores)."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    import public_tokenizers

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept, names = docs, docs.columns
    for name, stage in p.STAGES:
        out = stage(spark, kept, sf)
        was = {r["doc_id"]: r["text"] for r in kept.collect()}
        if name == "packing":
            break
        assert out.columns == names
        rows = out.collect()
        got = {r["doc_id"]: r["text"] for r in rows}
        assert len(got) == len(rows) and set(got) <= set(was)
        if name == "toxicity":
            scores = toxicity.score_toxicity(kept, *toxicity.learn(kept, spark.read.parquet(f"{sf}/labels.parquet")))
            assert set(got) == {r["doc_id"] for r in scores.collect() if r["score"] < toxicity.THRESHOLD}
        elif name == "ngram_jaccard":
            s = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in was.items()}
            up = {i: i for i in s}
            for i in s:
                for j in s:
                    if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                        a, b = find(up, i), find(up, j)
                        up[max(a, b)] = min(a, b)
            assert set(got) == {i for i in s if find(up, i) == i}
        elif name == "substring_dedup":
            first, must = {}, {}
            for i in sorted(was):
                w = words(was[i])
                for k in range(len(w) - 50):
                    if first.setdefault(tuple(w[k : k + 51]), i) != i:
                        must.setdefault(i, set()).update(range(k, k + 51))
            for i, t in was.items():
                w, left = words(t), words(got.get(i))
                at = iter(w)
                assert all(x in at for x in left), i  # only cuts
                assert len(left) <= len(w) - len(must.get(i, ())), i
                for k in range(len(left) - 50):  # no passage is left that another document starts with
                    assert first.get(tuple(left[k : k + 51]), i) == i
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
        else:
            hit = {i for i, _, n, *_ in window_hits(list(was.items()), bench) if n}
            assert set(got) == set(was) - hit
        if name not in ("substring_dedup",):
            assert all(got[i] == was[i] for i in got)
        kept = spark.createDataFrame(rows, out.schema)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, seqs = {}, {}
    for r in out.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(was)
    for i, t in was.items():
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for start, n, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + n], np.uint32).tobytes())
            at += n
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= pack.TOP and at & (at - 1) == 0
    assert p.run(spark, sf).agg({"length": "sum"}).first()[0] == sum(n for v in pieces.values() for _, n, _ in v)


def test_pipeline_of_odd_rows(spark):
    """Columns that the operators use themselves, shared and missing ids, nulls, wordless texts, an empty table."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    g = random.Random(1)
    make = lambda n: " ".join(f"w{g.randrange(9000)}" for _ in range(n))
    passage = make(80)
    rows = [(1, make(40)), (1, f"{make(30)} {passage}"), (2, passage + " " + make(20)), (2, passage + " " + make(20)), (None, make(20)), (3, None), (4, ""), (5, " \n"), (6, make(500)), (7, passage)]
    extra = ["n_rows", "spans", "v", "words", "sid", "n", "ends", "runs", "k"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(extra)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra))
    for data in (docs, docs.limit(0)):
        kept = data
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, kept, sf)
            assert out.columns == docs.columns, name
            kept = spark.createDataFrame(out.collect(), docs.schema)
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        if data is docs:
            assert {i for i, _ in got} == {None, 1, 2, 3, 4, 5, 6} - ({1} if len([i for i, _ in got if i == 1]) == 2 else set()) | {1}
            assert (None, rows[4][1]) in got and (3, None) in got and (4, "") in got and (5, " \n") in got
            assert sum(" ".join(words_) .count(passage) for words_ in [(t or "").split() for _, t in got]) == 1
            assert (1, rows[0][1]) in got
        packed = p.STAGES[-1][1](spark, kept, sf).collect()
        assert sum(r["length"] for r in packed) >= len(got)


def test_links_against_brute_force(spark):
    """Every seed's nth place goes to the nth (or last) of the first document that holds it, for a seed in all documents too."""
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 7)) + " " + common + (" gap" * 3 + " " + common) * (i % 3)) for i in range(40)] + [(90, "short"), (91, ""), (92, None)]
    docs = spark.createDataFrame(rows + [rows[5]], "doc_id long, text string")
    places = {}
    for r in set(map(tuple, chaining.seeds(docs).selectExpr("f", "doc_id", "explode(at) as p").collect())):
        places.setdefault(r[0], {}).setdefault(r[1], []).append(r[2])
    want = set()
    for by_doc in places.values():
        first = min(by_doc)
        there = sorted(by_doc[first])
        for d, own in by_doc.items():
            want |= {(d, first, x, there[min(n, len(there) - 1)]) for n, x in enumerate(sorted(own)) if d != first}
    got = set(map(tuple, chaining.links(docs).collect()))
    assert got == want and len({d for d, *_ in got}) == 39


ODD = [
    "a  b\tc\n d ", " lead", "tail ", "   ", "x" * 3000, "it's 12a É é!'s <|endoftext|> <s>", "中文 字符。 가나", "sign ▁ here", "aaaa" * 900 + " end", "\x00 nul", "ab" * 2500 + "'s" + "zq" * 1500,
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """The texts of `texts`, odd ones, a repeated row, rows without an id, other columns."""
    small_batches(spark)
    rows = [(i, t, "en", "s", len(t or ""), 7, 1) for i, t in enumerate([*texts(), *ODD])]
    return spark.createDataFrame([*rows, rows[3], rows[-1], rows[-1], (None, "no id at all here", "en", None, None, None, None)], SCHEMA).repartition(3)


def by_row(rows):
    return sorted(map(tuple, rows), key=str)


def plain_alignment(rows):
    """Columns of op11 of (doc_id, text) rows, each text encoded whole, each link in turn."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    signs = align.byte_table()
    byte = {i: bytes(signs.get(c, 0) for c in t) for t, i in ta.get_vocab().items()}

    def piece(i):
        m = re.fullmatch("<0x([0-9A-F]{2})>", p := tb.id_to_piece(i))
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    out, counts = [], Counter()
    for i, t in rows:
        a, b = (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)) if t else ([], [])
        xs, ys = [byte[x] for x in a], [piece(x) for x in b]
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            out.append((i, 0, 0, [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in xs]).tolist(), np.cumsum([len(x) for x in ys]).tolist()
        groups, p, q = [], 0, 0
        for c in sorted(set(ea) & set(eb)):
            u, v = ea.index(c, p) + 1, eb.index(c, q) + 1
            groups.append((a[p:u], b[q:v]))
            p, q = u, v
        links = [(x, y) for g, h in groups for x in g for y in h]
        counts.update(set(links))
        out.append((i, len(a), len(b), groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return counts, [
        (i, na, nb, len(g), len(x), sum(counts[k] == best[k[0]] for k in x), sum(counts[k] for k in x), hashlib.sha256(text(g).encode()).hexdigest() if g else "")
        for i, na, nb, g, x in out
    ]


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(odd_docs):
    counts, want = plain_alignment([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    got, pairs = align.align(odd_docs)
    assert by_row(got.select(ALIGNED).collect()) == by_row(want)
    assert {(r["a"], r["b"]): r["documents"] for r in pairs.collect()} == dict(counts)


def test_alignment_in_small_parts(odd_docs):
    """Texts worked out in parts, documents of several rows, and more shards give the same."""
    some = odd_docs.where("doc_id is null or doc_id % 4 = 3 or doc_id > 90")
    _, want = plain_alignment([(r["doc_id"], r["text"]) for r in some.collect()])
    assert by_row(align.align(some, part=60, chars=300, shard=500)[0].select(ALIGNED).collect()) == by_row(want)


def test_alignment_of_wide_groups(monkeypatch):
    """Groups whose pairs are not listed, lines of one unit that are not given back, texts in parts."""
    monkeypatch.setattr(align, "WIDE", 6)
    monkeypatch.setattr(align, "LINE", 3)
    pair = align.tokenizers(None, None)
    g = random.Random(3)
    atoms = ["a", "the", "ing", "'s", "'", "  ", " ", "\n", " \n", "<|endoftext|>", "<s>", "é", "中文", "가", "ſ", "12", "!", "▁", "\x00", "\x85", "\xa0", "zebra", "😀", "‍", "<0x41>", "_"]
    rows = list(enumerate([*texts()[::5], *ODD, *("".join(g.choice(atoms) for _ in range(g.randint(0, 40))) for _ in range(500))]))
    for (_, t), w in zip(rows, plain_alignment(rows)[1], strict=True):
        figures, parts = next(pair.documents([t], *g.choice([(60, 40), (1 << 20, 1 << 20)])))
        got = [x for k, _ in parts for x in k.tolist()]
        assert (*figures, len(set(got))) == (*w[1:5], w[7], len(got))


def test_alignment_of_a_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert by_row(align.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()) == by_row(plain_alignment(t)[1])


def test_pairs_of_a_large_group():
    g = np.random.default_rng(1)
    a, b = g.integers(0, 40, 500), g.integers(0, 30, 700)
    unit = align.Unit(a, b, np.arange(1, 501) * 7, np.append(np.arange(1, 700) * 5, 3500))
    want = Counter(int(x * 32 + y) for i0, i1, j0, j1 in zip([0, *unit.cuts_a], unit.cuts_a, [0, *unit.cuts_b], unit.cuts_b, strict=False) for x in a[i0:i1] for y in b[j0:j1])
    for most in (50, 1 << 40):
        parts = list(unit.pairs(32, most))
        keys = np.concatenate([k for k, _ in parts])
        assert len(np.unique(keys)) == len(keys)
        assert dict(zip(keys.tolist(), np.concatenate([n for _, n in parts]).tolist(), strict=True)) == want
    assert len(list(unit.pairs(32, 50))) > 5


def resampled(rows, aim, runs, percent, least, buckets=10_000, seed=2024):
    """op12 in plain Python: (doc_id, n_features, weight, score, rank)."""

    def features(t):
        w = [x.decode() for x in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(TR)) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    feats = [features(t) for _, t in rows]
    s, t = Counter(x for _, f in feats for x in f), Counter(x for y in aim for x in features(y)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, _), (n, f) in zip(rows, feats, strict=True):
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, None if i is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


SAMPLED = ["doc_id", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize(("runs", "percent", "least"), [(1, 10, 20), (3, 50, 2), (2, 100, 0)])
def test_resample(spark, odd_docs, runs, percent, least, monkeypatch):
    aim = [*texts()[:9], None, "", "Ä ß MIXED Case"]
    target = spark.createDataFrame([(x,) for x in aim], "text string")
    want = resampled([(r["doc_id"], r["text"]) for r in odd_docs.collect()], aim, runs, percent, least)
    got = resample.resample(odd_docs, target, runs, percent=percent, least_words=least).select(SAMPLED).collect()
    assert by_row(got) == by_row(want)
    assert sum(r["rank"] is not None for r in got) == sum(r[4] is not None for r in want) > 4


def test_resample_ties(spark):
    """All documents are the same: scores are the noise alone, and equal ones are ordered by doc_id."""
    rows = [(i % 700, "one two three " * 8) for i in range(1400)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("two",)], "text string"), percent=33)
    assert by_row(got.select(SAMPLED).collect()) == by_row(resampled(rows, ["two"], 1, 33, 20))


def test_pieces_of_long_texts():
    t = "Wörter, und " * 50 + "x" * 300 + " end"
    parts = list(resample.pieces(t, 37))
    assert "".join(parts) == t and len(parts) > 9
    split = lambda x: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x) if w]
    assert [w for p in parts for w in split(p)] == split(t)


def test_bpe_tree(spark, odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in odd_docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), ids, tok.decode(ids, skip_special_tokens=False)))
    for leaf in (bpetree.LEAF, 100):
        got = bpetree.encode_documents(odd_docs, leaf=leaf)
        assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
        assert by_row(got.collect()) == by_row(want)
    digest = [(i, n, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()) for i, n, ids, x in want]
    assert by_row(bpetree.encode_documents(odd_docs, digests=True, leaf=64).collect()) == by_row(digest)


def test_joins_of_parts_are_exact(monkeypatch):
    """Texts cut anywhere into tiny parts, with windows that begin tiny: each join gives the ids of the whole, also within runs of letters."""
    import public_tokenizers

    monkeypatch.setattr(bpetree, "TOKENS", 2)
    enc = bpetree.TreeEncoder(public_tokenizers.path("word_bpe_49k.json"), reach=2, far=4)
    g, joined = random.Random(4), []
    real = bpetree.TreeEncoder._in_letters
    monkeypatch.setattr(bpetree.TreeEncoder, "_in_letters", lambda *a: joined.append(x := real(*a)) or x)
    atoms = ["a", "the", "ing", "'s", "'", "S", "'ll", " ", "\n", "<|endoftext|>", "<|", "|>", "endoftext", "é", "é", "́", "12", "!", "...", "中文", "가", "ſ", "İ", "Σ", "\xa0", "\x85", "\x1c", "zebra", "aa", "_", "-", "😀", "‍"]
    kinds = [lambda: "".join(g.choice(atoms) for _ in range(g.randint(1, 60))), lambda: "".join(g.choice("ab") for _ in range(g.randint(1, 300))), lambda: "".join(g.choice("etaoinshrdlu") for _ in range(g.randint(1, 400))) + g.choice(["", "'s", "!"])]
    for k in range(900):
        t = kinds[k % 3]()
        ends = bpetree.halves(len(t), g.choice([3, 8, 20, 40]))
        parts = [t[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        assert enc.tree(t, ends, enc._encode(*parts)).tolist() == enc._encode(t)[0].tolist(), t
    assert sum(x is not None for x in joined) > 300


def test_bpe_tree_reads_little_around_a_join():
    """A run of 200,000 letters is joined by windows of a few letters, not encoded again."""
    import public_tokenizers

    enc = bpetree.TreeEncoder(public_tokenizers.path("word_bpe_49k.json"))
    g = random.Random(6)
    t = "".join(g.choice("etaoinshrdlucmf") for _ in range(200_000))
    ends = bpetree.halves(len(t), 10_000)
    parts = enc._encode(*[t[s:e] for s, e in zip([0, *ends], ends, strict=False)])
    read, real = [], enc._encode
    enc._encode = lambda *x: read.extend(map(len, x)) or real(*x)
    got = enc.tree(t, ends, parts)
    assert sum(read) < 10_000
    assert got.tolist() == real(t)[0].tolist()


def test_new_operators_of_empty_tables(spark, docs):
    none = docs.where("false")
    assert align.align(none)[0].count() == resample.resample(none, none).count() == bpetree.encode_documents(none).count() == 0
    assert resample.resample(docs, none).where("rank is not null").count() > 0

"""Joins and near-duplicate operators against brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import components, decontaminate, embedding_lsh, ngram_trees, substring_chain

DOC = "doc_id long, text string, component_id string, size string, source string, id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *["x"] * 4) for i, t in rows], DOC).repartition(parts)


def words(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(text, n, seed):
    rng = random.Random(seed)
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return out


def reach(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(501, 560)]
    frame = spark.createDataFrame([*links, (3, 3), (None, 5)], "a long, b long")
    want = reach({x for e in links for x in e}, links)
    got = {r["id"]: r["component_id"] for r in components.connected_components(frame).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and all(want[i] == i for i in want if i not in got)
    assert components.connected_components(frame.where("false")).count() == 0


def brute_sets(rows, n):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
    return out


def corpus():
    rows, i = [], 0
    common = words(60, 99)
    for k in range(60):
        base = words(random.Random(k).choice([5, 9, 30, 120, 400]), k)
        for copy in range(random.Random(k + 1).choice([1, 2, 6])):
            rows.append((i, " ".join(changed(base, copy * max(1, len(base) // 90), i))))
            i += 1
        rows.append((i, " ".join(common + base[:20])))
        i += 1
    for k in range(40):  # a large group of near copies, and copies of one
        rows.append((i, " ".join(changed(common + words(60, 5), k % 4, k))))
        rows.append((i + 1, "Same text  here\tfor all"))
        i += 2
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, n, percent):
    rows = [*corpus(), (9001, None), (9002, ""), (9003, " \t"), (9004, "One"), (9005, "oNE"), (9006, "x " * 30_000)]
    sets = brute_sets(rows, n)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = reach(ids, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_trees.near_duplicates(docs(spark, rows), n, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_with_several_texts_under_one_id(spark, seed):
    """Such rows are one document with the links of each text, by brute force."""
    rng = random.Random(seed)
    bases = [words(rng.choice([4, 12, 40, 90]), 1000 * seed + k) for k in range(30)]
    rows = [(rng.randrange(60), " ".join(changed(b, rng.choice([0, 0, 1, 2]), k))) for k, b in enumerate(rng.choices(bases, k=110))]
    sets = [brute_sets([r], 4)[r[0]] for r in rows]
    links = [(rows[x][0], rows[y][0]) for x, a in enumerate(sets) for y, b in enumerate(sets[:x]) if 100 * len(a & b) >= 85 * len(a | b)]
    want = reach({i for i, _ in rows}, links)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_trees.near_duplicates(docs(spark, rows)).collect())
    assert got == Counter((i, len(s), want[i]) for (i, _), s in zip(rows, sets, strict=True))


def test_ranges_with_repeated_ids_are_told_apart(spark):
    rows = [(key, i, g, 10, 4) for key, ids in ((1, (1, 4, 4, 9)), (2, (1, 5, 5, 9))) for g, i in enumerate(ids)]
    met = ngram_trees.ranges(spark.createDataFrame(rows, "key long, doc_id long, `group` long, size long, n long"), 85, 100)
    assert met.select("n", "first", "last", "all").distinct().count() == 2


def test_jaccard_join_without_the_first_step(spark, monkeypatch):
    """Routing and trees alone must find every link."""
    monkeypatch.setattr(ngram_trees, "FAN", 3)  # so that small trees have inner nodes
    rows = corpus()
    sets = brute_sets(rows, 4)
    ids = sorted(sets)
    want = reach(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    made = [(i, s, h) for i, s, h in ((i, ngram_trees.sets_of([(t or "").encode()], 4)[0], None) for i, t in rows)]
    least = Fraction(85, 100)
    counter = ngram_trees.Counter()
    counter.add([s for _, s, _ in made])
    frequent = np.sort(counter.frequent()[0])
    assert 0 < len(frequent)
    keyed = defaultdict(list)
    for i, s, _ in made:
        if len(s):
            for k in ngram_trees.keys_of(s, least, frequent).tolist():
                keyed[k].append(i)
    hashed = {i: s for i, s, _ in made}
    links = set()
    for group in keyed.values():
        group = sorted(set(group))
        if len(group) < 2:
            continue
        bits = min(ngram_trees.width(len(hashed[i])) for i in group)
        maps = np.stack([ngram_trees._fold(ngram_trees.bitmap(hashed[i]), bits) for i in group])
        rows_ = np.arange(len(group))
        for a, b in ngram_trees.candidate_pairs(rows_, rows_, np.array([len(hashed[i]) for i in group]), maps, rows_, least):
            links |= {(group[x], group[y]) for x, y in zip(a, b, strict=True) if ngram_trees.linked(hashed[group[x]], hashed[group[y]], least)}
    assert reach(ids, links) == want


def test_keys_of_sets_that_have_nothing_in_common():
    """Long disjoint sets meet in no key, and frequent shingles come last; borderline pairs share one at any size."""
    rng = np.random.default_rng(5)
    none = np.empty(0, dtype=np.uint64)
    for percent in (80, 85):
        least = Fraction(percent, 100)
        for size in (1, 2, 7, 30, 200, 1500):
            sets = [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(100)]
            keys = np.concatenate([ngram_trees.keys_of(s, least, none) for s in sets])
            assert len(np.unique(keys)) == len(keys)
            for s in sets:  # as different as a linked set may be
                out = int((100 - percent) / (100 + percent) * size)
                other = np.unique(np.concatenate([rng.permutation(s)[: len(s) - out], rng.integers(0, 1 << 63, out, dtype=np.uint64)]))
                late = np.sort(rng.permutation(np.concatenate([s, other]))[: size // 2])
                if ngram_trees.linked(s, other, least):
                    for frequent in (none, late):
                        assert np.intersect1d(ngram_trees.keys_of(s, least, frequent), ngram_trees.keys_of(other, least, frequent)).size


def test_join_of_nothing(spark):
    assert ngram_trees.near_duplicates(docs(spark, [(1, "a b")]).where("false")).count() == 0
    out = ngram_trees.near_duplicates(docs(spark, [(None, "a b c d e"), (2, "a b c d e"), (2, "a b c d e")])).collect()
    assert sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in out) == [("2", "2"), ("2", "2"), ("None", "None")]


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows = []
    for k in range(400):
        v = base[k % 40] + rng.normal(size=24) * 0.12
        rows.append((k, [float(np.float32(x)) for x in v]))
    rows += [(1000 + k, rows[5][1]) for k in range(30)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [None] + [1.0] * 23), (2003, [float("nan")] * 24), (2004, [float("inf")] + [0.0] * 23), (2005, [-0.0] * 23 + [1.0]), (2006, [0.0] * 23 + [1.0]), (2007, [1.0, 2.0]), (2008, []), (2009, [3 * x for x in rows[7][1]])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, kind):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links string, digest string").repartition(4)
    out = {r["vec_id"]: r for r in embedding_lsh.near_duplicates(frame).collect()}
    assert len(out) == len(rows)
    ok = {i: np.array(v, dtype=np.float32 if kind == "float" else float).astype(float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    true = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95]
    count = Counter(x for e in true for x in e)
    found = sum(r["n_links"] for r in out.values())
    assert found >= 0.99 * sum(count.values()) and all(r["n_links"] <= count[i] for i, r in out.items())
    assert out[2005]["n_links"] == 1 and out[2009]["component_id"] == out[7]["component_id"]
    for i in (2000, 2001, 2002, 2003, 2004, 2007, 2008):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    if found == sum(count.values()):
        want = reach(ids, true)
        assert all(out[i]["component_id"] == want[i] and out[i]["kept"] == (want[i] == i) for i in ids)
    assert embedding_lsh.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("size", [64, 384])
def test_recall_and_buckets_as_the_table_grows(size):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n in (10**4, 10**7, 10**9, 10**11):
        shape = embedding_lsh.shape_for(n, size)
        assert n / (2 * 2 ** (size - 1).bit_length()) ** shape.hashes <= embedding_lsh.FILL
        (a, pa_), (b, pb) = embedding_lsh.codes(x, shape), embedding_lsh.codes(y, shape)
        met = np.any([embedding_lsh._meet(a[:, t], pa_[:, t], b[:, t], pb[:, t]) for t in range(shape.tables)], axis=0)
        assert met.mean() >= 0.98, (n, shape)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_lsh, "BLOCK", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.ones(8) + rng.normal(size=8) * 0.02]) for i in range(150)]
    out = embedding_lsh.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["n_links"] <= 149 and r["component_id"] == 0 for r in out) and sum(r["n_links"] for r in out) >= 0.98 * 150 * 149


def best_chain(pieces):
    """The best score of any chain whose gaps are short enough, by looking at every earlier anchor of each."""
    score = []
    for j, (a, b, n) in enumerate(pieces):
        gaps = [(i, a - x - m, b - y - m) for i, (x, y, m) in enumerate(pieces[:j]) if x + m <= a and y + m <= b and max(a - x - m, b - y - m) <= substring_chain.MOST_GAP]
        score.append(n + max([0, *(score[i] - substring_chain.GAP_COST * (g + h) for i, g, h in gaps)]))
    return max(score)


def test_fenwick_chaining():
    rng = random.Random(0)
    for _ in range(300):
        wide = rng.choice([60, 300])
        pieces = sorted({(rng.randrange(wide), rng.randrange(wide), rng.randrange(5, 15)) for _ in range(rng.randrange(1, 25))})
        found = substring_chain.chains(pieces)
        assert sorted(i for _, c in found for i in c) == list(range(len(pieces)))
        for score, chain in found:
            gaps = [(pieces[j][0] - pieces[i][0] - pieces[i][2], pieces[j][1] - pieces[i][1] - pieces[i][2]) for i, j in zip(chain, chain[1:], strict=False)]
            assert all(0 <= g <= substring_chain.MOST_GAP for x in gaps for g in x)
            assert score == pytest.approx(sum(pieces[i][2] for i in chain) - substring_chain.GAP_COST * sum(g + h for g, h in gaps)) or chain is not found[0][1]
        assert found[0][0] == pytest.approx(best_chain(pieces))
    assert [c for _, c in substring_chain.chains([(0, 0, 1000), (1200, 1200, 20), (1225, 1226, 20)])] == [[0], [1, 2]]


def test_winnowing_by_windows():
    rng = np.random.default_rng(2)
    values, text = rng.integers(0, 40, 400).astype(np.uint64), np.sort(rng.integers(0, 30, 400))
    got = set(substring_chain.winnow(values, text).tolist())
    for t in set(text.tolist()):
        own = np.flatnonzero(text == t)
        for k in range(max(1, len(own) - substring_chain.LONG_WINDOW + 1)):
            window = own[k : k + substring_chain.LONG_WINDOW]
            assert any(values[i] == values[window].min() for i in got & set(own.tolist()) if values[i] <= values[window].min() and window[0] <= i <= own[-1])


def test_passages(spark):
    shared = words(70, 1)
    fuzzy = changed(shared, 3, 2)
    moved = shared[:35] + ["new"] + shared[36:]
    rows = [(0, " ".join(words(50, 10) + shared + words(40, 11))), (1, " ".join(words(30, 12) + fuzzy + words(20, 13))), (2, " ".join(shared)), (3, " ".join(words(300, 14))), (4, None), (5, ""), (6, "one two"), (7, " ".join(words(20, 15) + shared[:20] + words(20, 16))), (8, " ".join(moved + words(9, 17))), (None, " ".join(shared)), (2, " ".join(shared))]
    found = {(r["doc_id"], r["source"]): r for r in substring_chain.passages(docs(spark, rows)).collect()}
    assert set(found) == {(1, 0), (2, 0), (8, 0)}
    assert (found[2, 0]["first_word"], found[2, 0]["last_word"], found[2, 0]["source_word"]) == (0, 70, 50)
    assert abs(found[1, 0]["first_word"] - 30) <= 6 and abs(found[1, 0]["last_word"] - 100) <= 6
    cut = {r["doc_id"]: r["text"] for r in substring_chain.cut_out(docs(spark, rows)).collect()}
    assert cut[3] == rows[3][1] and cut[0] == rows[0][1] and cut[2] == "" and cut[4] is None
    assert not set(cut[8].split()) & set(shared) - set(words(9, 17)) and cut[7] == rows[7][1]
    report = {r["doc_id"]: (r["sources"], r["n_words"]) for r in substring_chain.report(docs(spark, rows)).collect()}
    assert report[2] == ([0], 70)
    assert substring_chain.passages(docs(spark, rows).where("false")).count() == 0


def brute_leaks(rows, items, least=0.8):
    out = {}
    for i, text in rows:
        w = (text or "").lower().split()
        for k, item in items:
            m = (item or "").lower().split()
            n = min(5, len(m))
            if not m or len(w) < len(m):
                continue
            grams = lambda x, n=n: Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))
            b = grams(m)
            best = max(sum((grams(w[s : s + len(m)]) & b).values()) / sum((grams(w[s : s + len(m)]) | b).values()) for s in range(len(w) - len(m) + 1))
            if best >= least:
                out[i, k] = best
    return out


def test_leaks(spark):
    items = [(0, " ".join(words(40, 1))), (1, " ".join(words(16, 2))), (2, "Three Little words"), (3, " ".join(["again"] * 12)), (4, None), (5, ""), (6, " ".join(words(40, 1)))]
    rows = [(0, " ".join(words(80, 5) + words(40, 1) + words(9, 6))), (1, " ".join(words(30, 7) + changed(words(40, 1), 1, 3)[:39] + words(5, 8))), (2, " ".join(words(16, 2))), (3, "so THREE little\nwords it is"), (4, None), (5, ""), (6, " ".join(words(200, 9))), (7, " ".join(["again"] * 30)), (8, " ".join(words(40, 1)[:20]))]
    for k in range(20):
        rows.append((100 + k, " ".join(words(20, k + 50) + changed(words(40, 1), k % 3, k)[k % 2 :] + words(20, k + 80))))
    frame = docs(spark, rows).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(frame, bench).collect()}
    want = brute_leaks(rows, items)
    assert got == pytest.approx(want) and len(want) > 10
    left = {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.leaks(frame, bench.where("false")).count() == 0
    assert decontaminate.leaks(frame.where("false"), bench).count() == 0


def test_leaks_plan_has_no_python(spark):
    plan = decontaminate.leaks(docs(spark, [(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_radius_is_guaranteed():
    rng = random.Random(4)
    masks = set(decontaminate._MASKS)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)))
        assert any(diff >> (8 * k) & 255 in masks for k in range(8))

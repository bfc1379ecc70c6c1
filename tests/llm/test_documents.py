"""Every operator on documents against brute force, over odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import decontaminate, licenses, near_dedup, packing, quality, sharding, substring_dedup
from tests_llm_rows import CLASHES, ROWS  # noqa: F401

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def space(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_near_groups(docs, empty):
    sets = []
    for i, t, *_ in ROWS:
        w = space(lower(t))
        sets.append((i, {tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set()))
    comp = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(ROWS)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(s), comp[i]) for i, s in sets)
    assert near_dedup.near_groups(empty).count() == 0


def test_one_id_with_two_texts_loses_no_link(spark):
    """Each text of an id is linked by itself; components go by texts."""
    a, b = (" ".join(f"{x}{i}" for i in range(25)) for x in "ab")
    rows = [(5, a), (5, b), (6, a), (7, b + " more"), (9, "alone here today now")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(5, 5), (5, 5), (6, 5), (7, 5), (9, 9)])


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Many texts around a shared line, in buckets over the limit, against all pairs."""
    import random

    monkeypatch.setattr(near_dedup, "SMALL", 2)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = base[:]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(40)] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(w + [f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 6))])))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_substring_dedup(docs, empty, rounds):
    first = {}
    texts = [(i, space(t)) for i, t, *_ in ROWS]
    big = 1 << 62
    for i, w in texts:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, big), big if i is None else i)
    want = Counter()
    for i, w in texts:
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < (big if i is None else i) for p in range(k, k + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substring_dedup.kept_texts(docs, digest=True, rounds=rounds).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    whole = substring_dedup.kept_texts(docs, untouched=True).where("doc_id = 3").first()
    assert whole.kept_text == " \n\t " and whole.n_removed == 0 and whole.lang == "en"
    assert substring_dedup.kept_texts(empty).count() == 0


@pytest.mark.parametrize("window", [5, 13])
def test_no_repeat_is_given_up(spark, window, monkeypatch):
    """Texts over few words with runs, periods and shared passages, in many small pieces, against brute force."""
    import random

    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 600)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 500)
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(window, 3 * window))] for _ in range(12)]
    passages += [["a"] * 20, ["a", "b"] * 15, ["a", "b", "c"] * 10, ["a", "a", "b", "b"] * 8]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(1, 4)):
            x = rng.choice(passages)
            at = rng.randrange(len(x))
            w += [rng.choice("abcdefghij") for _ in range(rng.randrange(6))] + (x if rng.random() < 0.5 else x[at:]) + [f"u{rng.randrange(10**6)}"] * rng.randrange(2)
        rows.append((rng.choice([None, i, i, i, i // 2]), " ".join(w)))
    first, big = {}, 1 << 62
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, big), big if i is None else i)
    want = Counter()
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (big if i is None else i) for p in range(k, k + window)}
        want[i, " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for rounds in (None, 1):
        assert Counter((r.doc_id, r.kept_text) for r in substring_dedup.kept_texts(docs, window=window, rounds=rounds).collect()) == want


def test_rounds_rule_windows_out():
    """Texts that share no passage leave no window to verify."""
    texts = [" ".join(f"{x}{i}" for i in range(200)).encode() for x in "pqr"]
    p = substring_dedup.Piece(texts, np.arange(3), 13)
    for _ in range(substring_dedup.rounds_of(13)):
        names, many = p.names()
        assert not many.any()
        p.learn(np.zeros(len(names), bool))
    assert substring_dedup.rounds_of(13) == 2 and len(p.windows()[0]) < 3 * 188 // 10


def test_repeats_are_cut_row_by_row(spark):
    """Rows of null or repeated ids lose their own repeats only."""
    passage = " ".join(f"p{i}" for i in range(20))
    other = [" ".join(f"{x}{i}" for i in range(30)) for x in "uv"]
    rows = [(1, passage), (None, passage), (None, other[0]), (5, passage + " tail"), (5, other[1]), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(1, passage), (None, ""), (None, other[0]), (5, "tail"), (5, other[1]), (None, "")])
    assert Counter((r.doc_id, r.kept_text) for r in substring_dedup.kept_texts(df).collect()) == want


def test_contamination(spark, docs, empty):
    items = [(1, " ".join(f"W{i}" for i in range(20, 40))), (2, "mit license"), (3, None), (4, "!!"), (2, "mit license"), (None, "b c")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t, *_ in ROWS:
        w, hit, names = ALNUM.findall(lower(t)), set(), set()
        for n, it in items:
            x = ALNUM.findall(lower(it))
            m = min(len(x), 13)
            for s in range(len(x) - m + 1 if m else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == x[s : s + m]:
                        hit.update(range(k, k + m))
                        names.add("null" if n is None else str(n))
        want[i, len(w), len(hit), ",".join(sorted(names))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.contamination(docs, frame).collect())
    assert got == want
    assert decontaminate.contamination(empty, frame).count() == 0
    assert decontaminate.contamination(docs, frame.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("bits", [4, 26])
def test_contamination_keeps_every_row(spark, docs, monkeypatch, bits):
    """Null and repeated ids, with different texts too, equal rows, long common passages, and a sieve that lets all through: against brute force."""
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)
    items = [(i, " ".join(f"w{k}" for k in range(a, b))) for i, (a, b) in enumerate([(5, 25), (10, 30), (5, 18), (40, 42), (50, 51)])] + [(7, "mit license"), (8, "aa " * 20)]
    more = [(None, "the mit license and " + " ".join(f"w{i}" for i in range(40))), (None, "clean words only"), (None, None), (9, "the mit license"), (9, "the mit license"), (9, "clean words only"), (20, "aa " * 30), (21, "aa " * 12)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = Counter()
    for i, t in [(r[0], r[1]) for r in ROWS] + more:
        w, hit, names = ALNUM.findall(lower(t)), set(), set()
        for n, it in items:
            x = it.split()
            m = min(len(x), 13)
            for s in range(len(x) - m + 1):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == x[s : s + m]:
                        hit.update(range(k, k + m))
                        names.add(str(n))
        want[i, len(w), len(hit), ",".join(sorted(names))] += 1
    found = decontaminate.contamination(rows, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found) == want


def test_licenses(docs, empty):
    got = licenses.scanned(docs).collect()
    assert len(got) == len(ROWS)
    for i, t, *_ in ROWS:
        w = ALNUM.findall(lower(t))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = next(r for r in got if r.doc_id == i)
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
    assert "apache-2.0" in next(r for r in got if r.doc_id == 13).labels
    assert licenses.scanned(empty).count() == 0


def test_license_labels(spark):
    """Labels by hand: notices whole, with words put in, left out or swapped, cut in half, twice in a text, and mixed with prose; and by brute force over diagonals."""
    import random

    rng = random.Random(21)
    full = {x: n[-1].split() for x, n in licenses.NOTICES.items()}
    prose = lambda k: rng.choices("the of and software license copy under terms any this is".split(), k=k)
    rows, sure = [], {}
    for x, w in full.items():
        edited = w[: len(w) // 2] + ["indeed"] + w[len(w) // 2 :]
        for kind, body, known in (("whole", w, True), ("put in", edited, True), ("half", w[: len(w) // 2], None), ("twice", w + prose(30) + w, True), ("prose", prose(60), None), ("short", licenses.NOTICES[x][0].split(), True)):
            rows.append((len(rows), " ".join(prose(rng.randrange(5)) + body + prose(rng.randrange(5)))))
            if known and len(w) > 15 or kind in ("whole", "short"):
                sure[len(rows) - 1] = x
    want = {}
    for i, t in rows:
        w, labels = ALNUM.findall(t), set()
        for words, x, base in [(p, x, True) for p, x in licenses.PHRASES.items()] + [(n, x, False) for x, ns in licenses.NOTICES.items() for n in ns]:
            m = words.split()
            k = min(3, len(m))
            hits = [(p - o, o, p) for p in range(len(w) - k + 1) for o in range(len(m) - k + 1) if w[p : p + k] == m[o : o + k]]
            spans = []
            for h in sorted(hits):
                if spans and h[0] - spans[-1][-1][0] <= licenses.DRIFT:
                    spans[-1].append(h)
                else:
                    spans.append([h])
            for s in spans:
                n = len(m) - k + 1
                if base and any(len([h for h in s if h[0] == d]) == n for d, _, _ in s):
                    labels.add(x)
                if not base and len({o for _, o, _ in s}) >= 0.8 * n and max(h[2] for h in s) - min(h[2] for h in s) + k <= 1.5 * len(m):
                    labels.add(x)
        want[i] = ",".join(sorted(labels))
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert all(x in got[i].split(",") for i, x in sure.items())


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    rows = packing.packed(packing.pieces(docs, with_ids=True)).collect()
    ids = {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        ids.setdefault(r.doc_id, {})[r.start] = r.ids
    for i, t, *_ in ROWS:
        whole = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert [x for s in sorted(ids[i]) for x in ids[i][s]] == whole
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.packed(packing.pieces(empty)).count() == 0


def test_plan_packs_every_piece():
    import random

    rng = random.Random(9)
    for _ in range(20):
        counts = {rng.randint(1, 1024): rng.randint(1, 500) for _ in range(rng.randint(1, 60))}
        done, total = Counter(), 0
        for lengths, n in packing.plan(counts):
            assert sum(lengths) <= 1024 and n > 0
            total += n
            for x in lengths:
                done[x] += n
        assert done == Counter(counts)


def test_index_of_sums_against_all_combinations():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(10):
        counts = {rng.randint(1, 40): rng.randint(0, 4) for _ in range(rng.randint(1, 12))}
        sums = packing.Sums(counts, 40)
        while True:
            there = [x for x in range(1, 41) if sums.left[x]]
            for k, index in ((1, sums.singles), (2, sums.pairs), (3, sums.triples)):
                want = Counter(sum(c) for c in itertools.combinations_with_replacement(there, k))
                assert [int(index[s]) for s in range(41)] == [want[s] for s in range(41)]
            for total in range(1, 41):
                assert list(sums.triples_of(total)) == sorted((c[::-1] for c in itertools.combinations_with_replacement(there, 3) if sum(c) == total), reverse=True)
            if not there:
                break
            sums.consume(*rng.choices(there, k=min(len(there), rng.randint(1, 3))))
            if rng.random() < 0.5:
                sums.consume(rng.choice(there))


def test_sharding(docs, empty, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 3)
    got = sharding.sharded(docs, shards=4).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == len(ROWS) and max(n.values()) - min(n.values()) <= 1
    for s, m in n.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(m))
    assert {(r._number, r._block, r._rank, r["dotted.name"], r.tags["a"]) for r in sharding.sharded(docs.withColumn("tags", F.create_map(F.lit("a"), F.lit(1))), shards=4).collect()} == {("clash", "clash", "clash", "clash", 1)}
    assert sharding.sharded(empty).count() == 0


def test_shuffle_is_uniform(spark, monkeypatch):
    """Chi-square of where rows of a third-sized crowd of equal rows, and all others, go: by shard, and by slot."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), (F.col("id") % 10).alias("part"))
    seen, slots = Counter(), Counter()
    for seed in range(4):
        rows = sharding.sharded(df, shards=6, seed=seed).collect()
        n = Counter(r.shard for r in rows)
        assert set(n.values()) == {500} and all(sorted(r.slot for r in rows if r.shard == s) == list(range(500)) for s in n)
        seen.update((r.part, r.shard) for r in rows)
        slots.update((r.part, r.slot // 100) for r in rows)
    for table, cells in ((seen, 60), (slots, 50)):
        each = 12000 / cells
        chi = sum((table[a, b] - each) ** 2 / each for a in range(10) for b in range(cells // 10))
        assert chi < cells + 4 * (2 * cells) ** 0.5


def test_matrix_law():
    """Draws of small matrices against the exact law: the multinomial of all ways to deal the rows."""
    from math import comb

    blocks, sizes, n = {0: 3, 1: 2, 2: 3}, [4, 2, 2], 20000
    got = Counter(tuple(map(tuple, sharding.matrix(blocks, sizes, seed).values())) for seed in range(n))
    ways = {}
    deals = lambda rows, left: [(a, b, rows - a - b) for a in range(min(rows, left[0]) + 1) for b in range(min(rows - a, left[1]) + 1) if rows - a - b <= left[2]]
    pick = lambda left, row: comb(left[0], row[0]) * comb(left[1], row[1]) * comb(left[2], row[2])
    for one in deals(3, sizes):
        left = [x - y for x, y in zip(sizes, one)]
        for two in deals(2, left):
            ways[one, two, tuple(x - y for x, y in zip(left, two))] = pick(sizes, one) * pick(left, two)
    total = sum(ways.values())
    assert set(got) <= set(ways)
    chi = sum((got[m] - n * w / total) ** 2 / (n * w / total) for m, w in ways.items())
    assert chi < len(ways) + 4 * (2 * len(ways)) ** 0.5


def test_hypergeometric_mean():
    import random

    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(3000)]
    assert abs(sum(draws) / 3000 - 6) < 0.2 and all(0 <= x <= 20 for x in draws)
    m = sharding.matrix({0: 7, 1: 0, 2: 13}, [5, 5, 5, 5], 3)
    assert [sum(m[b]) for b in (0, 1, 2)] == [7, 0, 13] and [sum(r[j] for r in m.values()) for j in range(4)] == [5, 5, 5, 5]


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(7, 1, 0), (9, 1, 0), (9, None, 0), (8, 1, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(docs, labels).collect()
    assert len(got) == len(ROWS) and all(r.kept is not None for r in got)
    assert all(r.kept for r in got if r.doc_id in (1, 2, 7, 8))
    assert quality.classified(docs, labels.limit(0)).where("NOT kept").count() == 0
    assert quality.classified(empty, labels).count() == 0


def test_kneser_ney_sums_to_one(spark):
    """Over all code points that training text has, and one for the rest, the probabilities of a context sum to one."""
    import math

    text = ["abab", "abc", "bca", "cab"]
    g = Counter(x for t in text for x in quality.grams([t])[0].tolist())
    counts = spark.createDataFrame(list(g.items()), "gram long, c long")
    seen = sorted({x & 0xFFFF for x in g})
    context = (1 << 48) | (ord("a") << 32) | (ord("b") << 16)
    asked = spark.createDataFrame([(context | x,) for x in [*seen, ord("z")]], "gram long")
    p = sum(math.exp(r.logp) for r in quality.probabilities(counts, asked).collect())
    assert abs(p - 1) < 1e-6


def test_model_equals_brute_force(spark, monkeypatch):
    """Scores of whole and of cut texts against interpolated modified Kneser-Ney by hand."""
    import math
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 30))), "en") for i in range(60)] + [(60, "idiot ab x1y (cad). #", "en"), (61, "ab\tcab", None)]
    trained = [i for i in range(40) if spark.range(1).selectExpr(f"pmod(xxhash64({i}L), {quality.HELD_OUT})").first()[0] != 0]
    counts = {4: Counter(g for i, t, _ in rows if i in trained for p in ["\x01" * 3 + t + "\x00"] for g in (p[k : k + 4] for k in range(len(p) - 3)))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k, c):
        n = Counter(counts[k].values())
        if not c or not n[1] or not n[2]:
            return 0 if not c else [0.5, 1.0, 1.5][min(c, 3) - 1]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0), j) if n[j] else 0.5 * j for j in (1, 2, 3)][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        of = {x: c for x, c in counts[len(g)].items() if x[:-1] == g[:-1]}
        if not of:
            return p(g[1:])
        c = of.get(g, 0)
        return (max(c - discount(len(g), c), 0) + sum(discount(len(g), x) for x in of.values()) * p(g[1:])) / sum(of.values())

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for size in (quality.PIECE_BYTES, 7):
        monkeypatch.setattr(quality, "PIECE_BYTES", size)
        got = {r.doc_id: r for r in quality.surprise(docs, docs.where("doc_id < 40").select("doc_id")).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            x = "\x01" * 3 + t + "\x00"
            nats = [-math.log(p(x[k : k + 4])) for k in range(len(x) - 3)]
            assert got[i].n_grams == len(nats) and abs(got[i].nats - sum(nats)) < 0.01 + 1e-4 * sum(nats)
            if size > 7:  # a word may be cut where a text is
                words = [m for m in re.finditer(r"(?<!\S)[^\w\s]*([a-z]+)[^\w\s]*(?!\S)", t)]
                worst = max((sum(nats[m.start(1) : m.end(1) + 1]) for m in words), default=0)
                assert abs(got[i].worst - worst) < 0.01, (t, got[i].worst, worst)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.classified(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1 and r.toxic == 0], [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2
    insults = re.compile("idiot|moron|worthless|disgusting|clown|stupid")
    toxic = docs.join(labels.where("doc_id % 3 = 0 AND toxic = 1 AND quality = 1"), "doc_id").collect()
    found = {r.doc_id: r.kept for r in got}
    named = [found[r.doc_id] for r in toxic if insults.search(r.text)]
    assert len(named) > 5 and sum(named) <= 0.2 * len(named)

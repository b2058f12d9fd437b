"""Prefix trie, conversation repair and document fingerprints against brute force, odd rows included."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm import embedding_dedup, fingerprints, mixing, prefix_trie, repair
from switchyard.llm._graph import connected_components
from switchyard.llm._running import running

CONV = "conv_id long, turn long, role string, text string"


def _conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "Ünï x", "ok.", "so!", None, "long " * 3000]
    rows = []
    for c in rng.sample(range(-7, 3 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 40])):
            turn = None if rng.random() < 0.05 else t + rng.choice([0, 0, 0, 1, 3])
            rows.append((c, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    rows += [rows[3], rows[3], (None, 1, "user", "no id."), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def _clashing(df):
    return df.withColumn("idx", F.lit(1)).withColumn("path", F.lit("p")).withColumn("x", F.lit(2)).withColumn("n", F.lit(3)).withColumn("tie", F.lit(0)).withColumn("piece", F.lit(0)).withColumn("k", F.lit("k")).withColumn("at", F.lit(7))


def _md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, _md5(r[2], r[3])))


# ---- running
def test_running_over_many_ranges(spark):
    """A group that spans ranges, null groups included, is numbered and summed as one."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), i, hashlib.md5(bytes([rng.randrange(4)])).digest(), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, x binary, n_bytes long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = running(df, "g", F.col("o").asc()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    paths, seen = defaultdict(set), defaultdict(list)
    want = {}
    for g, o, x, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        seen[g].append((x, b))
        want[g, o] = (len(seen[g]), sum(b for _, b in seen[g]))
    assert {(r.g, r.o): (r.idx, r.total) for r in got} == want
    for r in got:
        paths[bytes(r.path)].add((r.idx, tuple(x for x, _ in seen[r.g][: r.idx])))
    assert all(len(p) == 1 for p in paths.values())


# ---- prefix trie
def _trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((c, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in _ordered(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        lead = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        built[c] = own.get(lead, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 3)
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    rows = _conversations(seed)
    same = [(1000 + 5 * k + j, t, "user", f"t{t}.") for k in range(9) for j in range(5) for t in range(3 + (k == 4))]  # one group of copies
    got = prefix_trie.trie(_clashing(spark.createDataFrame(rows + same, CONV)).repartition(5)).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    assert {tuple(r) for r in got} == _trie(rows + same)


def test_trie_of_turnless_and_no_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).count() == 0
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    got = prefix_trie.trie(spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], CONV)).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# ---- conversation repair
def _damage(rows):
    out = []
    for c, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def _cheapest(initials, faults):
    """Best (cost, audit) by dynamic programming over whole audit strings."""
    best = {0: (0, "")}  # state -> (cost, audit) before the row; states as in the module

    def inserted(at):
        for _ in range(3):
            for q, (c, a) in list(at.items()):
                n = 3 if q == 2 else 2
                at[n] = min(at.get(n, (9e9, "")), (c + 5, a + "I"))
        return at

    best = inserted(best)
    for i, f in zip(initials, faults, strict=True):
        new = {}
        for q, (c, a) in best.items():
            steps = [(q, c + 2, a + "D")]
            if f in "kt":
                more, n = 5 if f == "t" else 0, 3 if q == 2 else 2
                steps.append((n, c + 1 + more, a + "R"))
                if i == "ua"[n == 3]:
                    steps.append((n, c + more, a + "K"))
                if i == "s" and q == 0:
                    steps.append((1, c + more, a + "K"))
            for n, cost, audit in steps:
                new[n] = min(new.get(n, (9e9, "")), (cost, audit))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def _spelled(rows, audit):
    out, state, at = [], 0, 0
    for e in audit:
        if e == "D":
            at += 1
            continue
        role, text = rows[at][2:] if e != "I" else ("", "")
        at += e != "I"
        if e == "K":
            state = 1 if role[:1] == "s" else 3 if state == 2 else 2
        else:
            state = 3 if state == 2 else 2
            role = {2: "user", 3: "assistant"}[state]
        out.append(f"{role}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def _repaired(rows):
    after = defaultdict(list)
    for r in _damage(rows):
        after[r[0]].append(r)
    out = set()
    for c in {r[0] for r in rows}:
        own = _ordered(after[c])
        turns = {r[1] for r in own if r[1] is not None}
        initials, faults = [r[2][:1] for r in own], _faults(own)
        cost, audit = _cheapest(initials, faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, _spelled(own, audit)))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_repair_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 7)
    rows = _conversations(seed)
    got = repair.repair(_clashing(spark.createDataFrame(rows, CONV)).repartition(3)).collect()
    assert {tuple(r) for r in got} == _repaired(rows) and len(got) == len({r[0] for r in rows})


def test_repair_of_nothing_and_of_dropped_rows(spark):
    assert repair.repair(spark.createDataFrame([], CONV)).count() == 0
    c = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(spark.createDataFrame([(c, 0, "user", "a")], CONV)).collect()
    assert [tuple(r) for r in got] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_search_equals_dynamic_programming_on_long_conversations():
    rng = random.Random(8)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 9, 30, 200] * 20 + [2500]:
        initials, faults = [rng.choice("suuao") for _ in range(n)], [rng.choice("kkkkbdt") for _ in range(n)]
        assert repair.cheapest("".join(map(repair.letter, initials, faults))) == _cheapest(initials, faults)


# ---- fingerprints
def _hash(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v, h)
    return h


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def _bins(text):
    words = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    if not words:
        return []
    shingles = {_hash(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    least = {}
    for h in shingles:
        b, v = _signed(h) % 257, h >> 11
        least[b] = min(least.get(b, 1 << 60), v)
    out = []
    for b, (c, o) in enumerate(fingerprints.walks()):
        walk = [b, *((o + pow(c, -1, 257) * t) % 257 for t in range(257))]
        out.append(least[next(j for j in walk if j in least)] & 255)
    return out


def _like(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 257 - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta river stone Cloud GREEN quiet north".split()
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 4, 5, 6, 20, 80, 300, 900]))) for _ in range(60)] + [None, "", " \t\n", "ünï \U0001f600 x²", "one\x0btwo\x1cthree", " ".join(rng.choices(words, k=20_000))]
    rows = [(7 * i - 20, t) for i, t in enumerate(texts)]
    rows += [rows[4]] * 5 + [(rows[8][0], "another text"), (None, "no id"), (None, "nor here"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("k", F.lit("k")).withColumn("at", F.lit(1)).withColumn("part", F.lit(1)).repartition(4)
    df.write.mode("overwrite").parquet(path := f"{fingerprints.C.new_path(spark, 'prints')}/documents.parquet")
    got = fingerprints.op13_fingerprints(spark, path.rsplit("/", 1)[0]).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'~' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest())
    order = sorted(rows, key=key)
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, e, n = _bins(t), _bins(edited), _bins(u)
        text_of = lambda b: "".join(f"{v:02x}" for v in b)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(e), round(_like(a, e), 9), round(_like(a, n), 9)))
    found = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    again = spark.createDataFrame([(got[0].fingerprint,), ("",)], "f string").select(fingerprints.packed(fingerprints.unpacked(F.col("f"))).alias("g")).collect()
    assert [r.g for r in again] == [got[0].fingerprint, ""]


def test_fingerprints_estimate_jaccard(spark):
    """Without bias, and within the stated deviation."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    pairs = []
    for _ in range(150):
        a = rng.choices(words, k=rng.choice([40, 200, 900]))
        pairs.append((" ".join(a), " ".join(a[: int(len(a) * rng.random())] + rng.choices(words, k=30))))
    jaccard = lambda a, b: (lambda x, y: len(x & y) / len(x | y))(*({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.likeness(fingerprints.bins(F.col("a")), fingerprints.bins(F.col("b"))).alias("j")).collect()
    errors = [r.j - jaccard(r.a, r.b) for r in rows]
    assert abs(sum(errors)) / len(errors) < 0.01 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.04


def test_empty_and_single_documents(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edits(spark.createDataFrame([], schema)).count() == 0
    (row,) = fingerprints.edits(spark.createDataFrame([(3, "abcdef")], schema)).collect()
    assert row.edited == "abcabc" and row.own == row.next


# ---- repeated ids and equal rows in earlier operators
def test_a_vec_id_may_repeat_with_other_vectors_and_be_a_string(spark):
    rows = [("7", [1.0, 0.0], 1), ("7", [0.0, 1.0], 1), ("8", [1.0, 0.01], 1), ("8", [1.0, 0.01], 1), ("9", [1e200, 1e198], 1), ("a", [1e-200, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or "", r.n_links, r.component_id or "", r.kept) for r in got) == [("", 0, "", True), ("7", 0, "7", True), ("7", 4, "7", True), ("8", 4, "7", False), ("8", 4, "7", False), ("9", 4, "7", False), ("a", 4, "7", False)]


def test_repeated_rows_are_emitted_as_often_as_the_mix_takes_them(spark):
    rows = [(1, "a", "x " * 10)] * 20 + [(2, "b", "y " * 10)] * 20 + [(None, "c", f"z{i} z") for i in range(50)] + [(3, "b", f"y{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.col("repeats") * F.col("size")).alias("n")).collect()}
    out = mixing.repeat_documents(docs)
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    target = {r.source: r.t for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t")).collect()}
    assert got == want and all(abs(got[s] - target[s]) <= 10 for s in got)


def test_rows_without_an_id_spread_over_the_bins_of_the_order(spark):
    docs = spark.createDataFrame([(None, "a", f"text {i}") for i in range(20_000)], "doc_id long, source string, text string")
    per_bin = docs.groupBy(F.substring(mixing._place("s"), 1, 3).alias("b")).count().agg(F.max("count")).first()[0]
    assert per_bin < 40


def test_components_without_links_take_no_round(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_hot_keys_and_hubs_are_dealt_over_tasks(spark, monkeypatch):
    """The salted join gives what the plain one does; components do not change with it."""
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(600)] + [(None, 1)], "key long, v long")
    keyed = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "key long, name string")
    want = sorted(map(tuple, rows.join(keyed, "key").collect()))
    assert sorted(map(tuple, C.spread_join(rows, keyed, "key", "v", hot=100, parts=4).collect())) == want
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, C.spread_join(rows, keyed, "key", "v", hot=50, parts=4, counts=counts).collect())) == want
    binary = rows.select(F.col("key").cast("string").cast("binary").alias("key"), "v")
    assert C.spread_join(binary, keyed.select(F.col("key").cast("string").cast("binary").alias("key"), "name"), "key", "v", hot=100).count() == len(want)
    real = C.spread_join
    monkeypatch.setattr(C, "spread_join", lambda *a, **k: real(*a, **k | {"hot": 20, "parts": 3}))
    edges = [(0, k) for k in range(1, 200)] + [(k, 1000 + k) for k in range(1, 200)] + [(5000, 5001)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: 0 for e in edges[:-1] for v in e} | {5000: 5000, 5001: 5000}


def test_a_deep_conversation(spark):
    """As many nodes as turns, in as many rounds as for a flat one."""
    rows = [(5, t, "user", f"{t}.") for t in range(5000)] + [(10, t, "user", f"{t}.") for t in range(4000)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(spark.createDataFrame(rows, CONV)).collect()}
    assert len(got) == 5001 and got[5, 4000].n_convs == 2 and got[5, 4001].n_convs == 1
    assert got[5, 3999].saved_tokens == len("3998.") + len("3999.") and got[5, 0].n_leaves == 1

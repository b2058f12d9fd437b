"""Every operator on odd rows (null, empty, very long, repeated, clashing columns) and against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm import embedding_dedup, language, licenses, media, mixing, near_copies, packing, quality, simhash, token_counts, toxicity
from switchyard.llm._graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, rank int, component string"


def _words(rng, n, stock="alpha beta gamma delta river stone cloud green quiet north".split()):
    return " ".join(rng.choice(stock) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [_words(rng, rng.randint(3, 80)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " tail", None, "", " \t\n", "Ünï \x1cx²y", "!!!", "a", "x" * 5000, _words(rng, 30_000)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None]), 1, 0.5, 7, 1, "c") for i, t in enumerate(texts)]
    return [*out, out[5], (None, "no id here at all", "en", "s1", 1, 0.1, 1, 1, "c")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(4)
    good = [_words(rng, 40) for _ in range(120)]
    junk = [" ".join(f"{w.upper()}!!" for w in _words(rng, 30).split()) for _ in range(120)]
    rude = [_words(rng, 20) + f" {rng.choice(['idiot', 'moron', 'idiots', 'morons'])} " + _words(rng, 10) for _ in range(120)]
    data = [(i, t, "en", "s", 1 if i < 120 or i >= 240 else 0, int(i >= 240)) for i, t in enumerate(good + junk + rude)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, quality int, toxic int")


def test_toxicity(spark, docs, empty, labels):
    texts = labels.select("doc_id", "text")
    score = toxicity.scorer(spark, toxicity.fit(texts, labels, "toxic", 3, 1, bits=14))
    got = labels.select("toxic", C.fold(F.col("doc_id"), 3, 1).alias("held"), score("text").alias("s")).where("held").toPandas()
    assert ((got.s >= 0.7) == (got.toxic == 1)).mean() > 0.95
    misspelt = spark.createDataFrame([("stone river idiiot north cloud",), ("stone river alpha north cloud",)], "text string").select(score("text").alias("s")).toPandas().s
    assert misspelt[0] > misspelt[1]
    out = docs.select("doc_id", score("text").alias("p")).toPandas()
    assert len(out) == docs.count() and out.p.between(0, 1).all()
    kept = toxicity.keep_clean(docs, labels)  # no labelled row of both classes among these documents: nothing goes
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.keep_clean(empty, labels).count() == 0
    none = toxicity.fit(texts, labels.limit(0), "toxic", 3, 1)
    assert none.proba(none.logits(["x"], toxicity.WordRows(none.rows)))[0, 1] < 0.5


def test_quality(spark, docs, empty, labels):
    texts = labels.select("doc_id", "text")
    score = quality.scorer(spark, quality.fit(texts, labels, min_count=2))
    got = labels.select("quality", C.fold(F.col("doc_id"), 4, 2).alias("held"), score("text").alias("s")).where("held").toPandas()
    assert ((got.s >= 0.7) == (got.quality == 1)).mean() > 0.95
    out = docs.select(score("text").alias("p")).toPandas()
    assert len(out) == docs.count() and out.p.between(0, 1).all()
    assert quality.keep_good(empty, labels).columns == empty.columns
    assert quality.fit(texts, labels.limit(0)).prior == 0.0


def test_language(spark, docs, empty):
    rng = random.Random(5)
    a, b = "the of and with from that".split(), "der die das und mit von".split()
    train = spark.createDataFrame([(i, _words(rng, 20, a if i % 2 else b), "en" if i % 2 else "de") for i in range(300)], "doc_id long, text string, lang string")
    detect = language.detector(spark, language.fit(train))
    got = train.select("lang", C.fold(F.col("doc_id"), 4, 2).alias("held"), detect("text").alias("d")).where("held").select("lang", "d.*").toPandas()
    assert (got.lang == got.lang_pred).all() and got.score.between(0, 1).all()
    odd = docs.select("text", detect("text").alias("d")).select("text", "d.*").toPandas()
    letters = odd.text.map(lambda t: bool(t) and any(c.isalpha() for c in t))
    assert ((odd.lang_pred == "und") == ~letters).all() and (odd.score[~letters] == 0).all()
    assert language.fit(empty).model is None


def test_token_counts(spark, docs):
    rollup = token_counts.Rollup(spark, C.new_path(spark, "t"))
    image = lambda n, tok="v1", src="s": {"source": src, "lang": None, "tokenizer": tok, "n_tokens": n}
    kind = "op string, before struct<source:string,lang:string,tokenizer:string,n_tokens:long>, after struct<source:string,lang:string,tokenizer:string,n_tokens:long>"
    batch = lambda rows: spark.createDataFrame(rows, kind)
    totals = lambda: {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert totals() == {}
    assert rollup.commit("b1", batch([("insert", None, image(5)), ("insert", None, image(7)), ("insert", None, image(None, src=None))]))
    assert not rollup.commit("b1", batch([("insert", None, image(99))]))
    assert totals() == {("s", "v1"): (2, 12), (None, "v1"): (1, 0)}
    rollup.commit("b2", batch([("revise", image(5), image(6, "v2")), ("delete", image(7), None)]))
    rollup.commit("b3", batch([]))
    assert totals() == {("s", "v2"): (1, 6), (None, "v1"): (1, 0)} and rollup.batches() == ["b1", "b2", "b3"]
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("b4", batch([("upsert", None, image(1))]))
    assert not rollup.committed("b4")
    with pytest.raises(ValueError):
        rollup.commit("../x", batch([]))


def test_media(spark, docs, empty):
    root = C.new_path(spark, "m")
    stored = media.store(docs, root, shard_bytes=20_000)
    found = media.read_back(media.metadata(media.addresses(stored), root), root)
    got = stored.select("doc_id", "n_bytes", "digest").join(found, "digest").join(docs.select("doc_id", "text").distinct(), "doc_id").toPandas()
    for r in got.itertuples():
        payload = media.pad((r.text or "").encode())
        assert r.payload_bytes == len(payload) >= 64 and not len(payload) % 64
        assert bytes(r.payload_sha256) == hashlib.sha256(payload).digest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert stored.count() == docs.count()
    assert got.groupby(got.text.fillna(""))["offset"].nunique().max() == 1  # one address for equal texts
    import tarfile

    fs, path = media.filesystem(root)
    for name in {r["shard"] for r in got.to_dict("records")}:
        with tarfile.open(f"{path}/{name}") as tar:
            assert all(hashlib.sha256(tar.extractfile(m).read()).hexdigest() + ".png" == m.name for m in tar)
    assert media.store(empty, C.new_path(spark, "m")).count() == 0
    with pytest.raises(ValueError):
        media.read_header(b"\x89PNG" + bytes(29))


def test_licenses(spark, docs, empty):
    mit, gpl = licenses.TEMPLATES[2][1], licenses.TEMPLATES[6][1]
    broken = " ".join(w for k, w in enumerate(gpl.split()) if k % 6)
    texts = [(1, "start " + mit.upper() + " end"), (2, "pre " * 3000 + gpl), (3, broken), (4, "Released under the MIT License."), (5, None), (6, ""), (7, "license"), (4, "Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    assert {(r.doc_id, r.license) for r in got.itertuples()} == {(1, "MIT"), (2, "GPL-3.0-or-later"), (4, "MIT")} and len(got) == 3
    assert (got.containment >= 0.8).all() and got.set_index("doc_id").first_word[1] == 2
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.check_anchors([("X", "one two three four five six")], ["licens"])


def test_short_licenses(spark, docs, empty):
    texts = ["stone river. All rights\nreserved. cloud", "License: GPLv3", "mit LICENSE", "// SPDX-License-Identifier: AGPL-3.0-or-later", "under the GNU Lesser General Public License", "CC0", "all rights are reserved", None, "Released under the MIT License."]
    got = licenses.notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    found = {i: set(g.license) for i, g in got.groupby("doc_id")}
    assert found == {0: {"LicenseRef-All-Rights-Reserved"}, 1: {"GPL-3.0"}, 2: {"MIT"}, 3: {"AGPL-3.0", "AGPL-3.0-or-later"}, 4: {"LGPL"}, 5: {"CC0-1.0"}, 8: {"MIT"}}
    assert not got.duplicated(["doc_id", "template_id"]).any() and got.set_index("doc_id").first_word[0] == 3
    assert licenses.notices(docs).count() == 0 and licenses.notices(empty).count() == 0


def _print(text):
    ws = (text or "").encode().lower().split()
    hs = [xxhash.xxh64(b" ".join(ws[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_simhash_fingerprints(rows):
    for r in rows:
        assert simhash.fingerprint(r[1]) == _print(r[1])


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_links(spark, bucket):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base[:6]:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {base[0] ^ (1 << i) for i in range(12)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    comp = {r.vertex: r.component for r in connected_components(simhash.links(df, bucket=bucket)).collect()}
    roots = _components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    groups = {}
    for p, r in zip(prints, roots, strict=True):
        groups.setdefault(r, []).append(sign(p))
    for g in groups.values():
        assert {comp.get(p, p) for p in g} == {min(g)}


def test_simhash_documents(docs, empty):
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == docs.count()
    by = got.dropna().drop_duplicates("doc_id").set_index("doc_id").component_id
    assert by[60] == by[61] == by[0] == 0 and by[63] == by[64] == by[65]
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted(set(by)) and None in ids
    assert simhash.keep_one(empty).count() == 0


def test_simhash_keeps_the_least_of_repeated_ids(spark):
    data = [(1, "b c d e f", 8), (1, "a b c d e", 9), (2, "x y z v w", 7), (3, "x y z v w", 6), (4, None, 5), (4, "", 4)]
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string, _least int"))
    assert got.columns == ["doc_id", "text", "_least"]
    found = sorted((r[0], r[1], r[2]) for r in got.collect() if r[0] != 4)
    assert found == [(1, "a b c d e", 9), (1, "b c d e f", 8), (2, "x y z v w", 7)]  # one id, two texts: neither copies the other
    assert got.where("doc_id = 4").count() == 1


def test_pipeline_drops_near_copies(spark, docs, empty):
    import corpus_pipeline

    rng = random.Random(12)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 120))] for _ in range(25)]
    texts = []
    for k, ws in enumerate(base):
        for _ in range(150 if k == 0 else 4):
            copy = list(ws)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    data = [*enumerate(texts), (1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two")]
    sets = {i: {tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} if (ws := (t or "").lower().split()) else set() for i, t in data}
    close = lambda a, b: sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = sorted(r.doc_id for r in stage(spark, df, "").collect())
    assert not [(a, b) for a in kept for b in kept if a < b and close(a, b)]
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert all(group[b] < b or any(close(a, b) for a in range(b)) for b in range(len(texts)) if b not in kept)
    assert {1000, 1002} <= set(kept) and not {1001, 1003} & set(kept)  # an empty text copies a null one
    out = near_copies.keep_first(docs)
    assert out.columns == docs.columns and None in [r.doc_id for r in out.select("doc_id").collect()] and near_copies.keep_first(empty).count() == 0


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)], "a long, b long")
    got = {r.vertex: r.component for r in connected_components(path).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[300] == got[301] == 300 and 500 not in got


@pytest.mark.parametrize("tile", [1024, 8])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(120, 16))
    near = np.vstack([v[0] + rng.normal(scale=0.03, size=16) for _ in range(40)] + [v[1] + rng.normal(scale=0.1, size=16) for _ in range(30)])
    x = np.vstack([v, near, v[2:4], 3 * v[4:6]]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    label[[0, *range(120, 160)]] = 1
    data = [(i, [float(c) for c in x[i]], int(label[i]), 1.0) for i in range(len(x))]
    odd = [(900, None, 1, 0.0), (901, [0.0] * 16, 1, 0.0), (902, [float("nan")] * 16, 1, 0.0), (903, [float(c) for c in x[0]], None, 0.0), (904, [1.0, None] * 8, 1, 0.0), (905, [1.0] * 3, 1, 0.0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int, factor double"), tile=tile).toPandas().set_index("vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    roots = np.array(_components(len(x), np.argwhere(linked)))
    assert (got.n_links[: len(x)].to_numpy() == linked.sum(1)).all()
    least = {r: min(np.nonzero(roots == r)[0]) for r in set(roots)}
    assert [least[r] for r in roots] == got.component_id[: len(x)].tolist()
    for i in range(900, 906):
        assert (got.n_links[i], got.component_id[i], got.kept[i]) == (0, i, True)


def test_small_buckets_are_compared_together(monkeypatch):
    """Five hundred buckets cost two groups (one a dimension), not one each, and give what they give one by one."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(500):
        dim, n, tiled = (16, 24)[k % 2], 2 + k % 6, k % 5 == 0
        x = rng.normal(size=dim) + rng.normal(scale=0.08, size=(n, dim))
        code, factor, ints, low, step = embedding_dedup.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
        band = 2  # behind the bits of the estimates; pairs that agree in an earlier band count there
        code.view(np.uint16)[:, band] = k  # one bucket
        rows += [{"dim": dim, "band": band, "rep": 10 * k + i, "copies": 1 + i % 3, "raw": x[i].tobytes(), "code": code[i].tobytes(), "ints": ints[i].tobytes(), "factor": factor[i], "low": low[i], "step": step[i], "slot": i % 2, "i": 0, "j": int(tiled), "k": k} for i in range(n)]
    b = pd.DataFrame(rows)
    starts = np.nonzero(np.diff(b["k"], prepend=-1))[0]
    one_by_one = [embedding_dedup._Group(g, 0.98).compare(0, int(g["j"].iloc[0])) for _, g in b.groupby("k")]
    made, init = [], embedding_dedup._Group.__init__
    monkeypatch.setattr(embedding_dedup._Group, "__init__", lambda self, *a: (made.append(1), init(self, *a))[1])
    together = list(embedding_dedup.compared(b, starts, 0.98))
    plain = lambda parts: sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts, strict=True)), strict=True))
    assert len(made) == 2 and len(plain(together)) > 100 and plain(together) == plain(one_by_one)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(packing.tokenizer_json())
    got = packing.pack(docs).toPandas()
    for i, t in {(r.doc_id, r.text) for r in docs.dropna(subset=["doc_id"]).collect()}:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[:-1] == 2048).all()
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine.itertuples()] == mine.ids_crc32.tolist()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(empty).count() == 0


def test_word_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(packing.tokenizer_json())
    words = packing.WordIds(tok, cap=20)
    rng = random.Random(8)
    texts = ["a'b don't l'été x²y", "fi<|endoftext|>z <|ENDOFTEXT|>", "İstanbul ΣΑΣ ΟΔΟΣ, é q\tw\x1ce  ", "İ[ İ\u094d <| İ.", "J\u030c H\u0331 T\u0308 <| W\u030a!", "한국어 1234 a1b2!!! ### _x_ \xa0z", "", "\n \n", *("".join(rng.choice("abÉß1 .,!'\n\tΣ́²") for _ in range(60)) for _ in range(200))]
    for t in texts:
        assert next(words.ids([t])) == np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400) if seed % 2 else np.clip(rng.geometric(0.03, 400), 1, 100)
    hist = np.bincount(lengths, minlength=101)
    runs, bins = packing.plan(hist, 100)
    load, seen, large = np.zeros(bins, int), np.zeros(101, int), np.zeros(bins, int)
    for length, rank, first, items, offset in sorted(runs.tolist(), key=lambda r: (-r[0], r[1])):
        later = [r for r in runs.tolist() if r[0] == length and r[1] > rank]
        n = (min(r[1] for r in later) if later else hist[length]) - rank
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            b = first + k // items
            assert load[b] == offset + k % items * length
            load[b] += length
            large[b] += length > 33
    assert (seen == hist).all() and load.max() <= 100 and large.max() <= 2
    gaps = []  # best-fit decreasing, one piece at a time
    for length in sorted(lengths.tolist(), reverse=True):
        best = min((g for g in gaps if g >= length), default=None)
        if best is None:
            gaps.append(100 - length)
        else:
            gaps.remove(best)
            gaps.append(best - length)
    assert bins <= len(gaps)


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count()
    sizes = got.groupby(got.source.fillna("~")).agg(size=("size", "sum"), target=("target", "first"), told=("source_size", "first"))
    assert (sizes["size"] == sizes.told).all() and np.isclose(sizes.target.sum(), sizes["size"].sum())
    assert (sizes.target <= 3 * sizes["size"] + 1e-6).all() and (got.repeats <= 3).all()
    free = dict(zip(sizes.index, (1, 2, 3, 1), strict=True))  # by code point, null last
    left, held = set(sizes.index), set()
    while True:
        rest = sizes["size"].sum() - sum(3 * sizes["size"][s] for s in held)
        over = {s for s in left if 3 * sizes["size"][s] < rest * free[s] / sum(free[x] for x in left)}
        if not over:
            break
        held |= over
        left -= over
    for s in left:
        assert np.isclose(sizes.target[s], rest * free[s] / sum(free[x] for x in left))
    again = mixing.mix(docs.repartition(2)).toPandas()
    key = ["doc_id", "size", "repeats"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns and mixing.repeat_documents(empty).count() == 0
    clash = docs.selectExpr("doc_id", "text", "source", "1 as _k", "2 as _Id", "'x' as _source", "3 as _size", "4 as _repeats", "5 as _h", "6 as weight", "7 as target")
    again = mixing.repeat_documents(clash)
    assert again.columns == clash.columns and again.count() == out.count()
    assert [tuple(r) for r in again.select(*clash.columns[3:]).distinct().collect()] == [(1, 2, "x", 3, 4, 5, 6, 7)]
    taken = {(r.doc_id, r.size): r.repeats for r in got.itertuples() if r.doc_id == r.doc_id and r.doc_id != 5}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counts.get(i, 0) == n for (i, _), n in taken.items())


def test_no_source_is_taken_more_than_three_times(spark):
    data = [(i, "small" if i < 4 else "large", "" if i % 4 == 0 else "w " * 50) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = mixing.mix(docs, spark.createDataFrame([("small", 9), ("large", 1)], "source string, weight long")).toPandas()
    assert (got[got.source == "small"].target == 3 * 150).all() and got.repeats.max() == 3


def test_mixing_lands_near_targets(spark):
    rng = random.Random(9)
    data = [(i, f"s{i % 3}", "w " * rng.randint(0, 40)) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, source string, text string")).toPandas()
    got["taken"] = got.repeats * got["size"]
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() <= 20).all()


def test_license_gate_passes_runs_of_words_only(spark):
    """Fragments of other words ('example', 'discover', 'accept') send no text to the hashes; every template passes, whatever parts its words."""
    texts = ["for example, discover and accept 4 fees", "sample rights of the domain", "miscellany cc 4 by 0", "xgplv3", "all rights, reservedly", None, ""]
    every = licenses.TEMPLATES + licenses.SHORT_FORMS
    runs = [t for t in every if len(licenses._words(t[1])) <= licenses.WORDS]
    gate = licenses.holds(F.col("text"), licenses.ANCHORS + licenses.SHORT_ANCHORS, runs)
    table = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    assert table(texts).where(gate).count() == 0
    whole = [f"\u00e9 {t.upper().replace(' ', ' \u2014\n')}." for _, t in every]
    assert table(whole).where(gate).count() == len(whole)
    assert table([f"({t})" for _, t in runs]).where(licenses.holds(F.col("text"), [], runs)).count() == len(runs)


def test_licenses_of_rows_without_an_id(spark):
    text = "It is released under the MIT License as ever."
    got = licenses.scan(spark.createDataFrame([(None, text), (None, "nothing here"), (3, text)], "doc_id long, text string"))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["3", "None"]


def test_spread_join_deals_hot_keys(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    keyed = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, rows.join(keyed, "k").select("doc_id", "k", "v").collect()))
    for hot in (100, 100_000):
        got = C.spread_join(rows, keyed, "k", "doc_id", hot=hot)
        assert sorted(map(tuple, got.select("doc_id", "k", "v").collect())) == want and sorted(got.columns) == ["doc_id", "k", "v"]


def test_scratch_needs_a_shared_folder_off_local(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return Cluster.conf

    with pytest.raises(RuntimeError, match="checkpoint"):
        C.shared_dir(Cluster)


def test_samples(spark):
    """By hash order, bounded by rows and characters, whole texts, whatever their length."""
    labelled = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)] + [(5, 9), (None, 1)], "doc_id long, y int")
    picked, counts = C.bounded_sample(labelled, 50, 100)
    assert counts == {0: 1800, 1: 200} and [sum(y == c for _, y in picked) for c in (0, 1)] == [50, 50]
    assert picked == C.bounded_sample(labelled.repartition(7), 50, 100)[0]
    docs = spark.createDataFrame([(i, "x" * (1000 if i % 10 == 0 else 10)) for i in range(2000)], "doc_id long, text string")
    texts = C.fetch_texts(docs, picked, 5000)
    assert sum(len(t) == 10 for t in texts.values()) == 50 and sum(len(t) == 1000 for t in texts.values()) == 5
    assert len(C.fetch_texts(docs, picked, 1)) == 2  # the first of each class


def test_media_ends_a_shard_by_rows(spark, tmp_path):
    root = f"file://{tmp_path}/shards"
    rows = media.store(spark.createDataFrame([(i, "the same") for i in range(25)], "doc_id long, text string").coalesce(1), root, shard_rows=10)
    assert rows.count() == 25 and rows.select("shard").distinct().count() == 1  # equal members, equal names, written once
    assert not [p.name for p in (tmp_path / "shards").iterdir() if p.name.startswith("_writing")]
    many = media.store(spark.createDataFrame([(i, f"text {i}") for i in range(25)], "doc_id long, text string").coalesce(1), root, shard_rows=10)
    assert many.select("shard").distinct().count() == 3


def test_rollups_compact(spark, tmp_path):
    image = "struct<source:string,lang:string,tokenizer:string,n_tokens:bigint>"
    batch = lambda n, op="insert": spark.createDataFrame([(op, None, ("s", "en", "t", n))], f"op string, before {image}, after {image}")
    r = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    assert r.commit("a", batch(3)) and r.commit("b", batch(4))
    r.compact()
    assert r.totals().first().n_tokens == 7 and not r.commit("a", batch(3))
    assert r.commit("c", batch(5)) and r.totals().first().n_tokens == 12
    r.compact()
    r.compact()
    assert (r.totals().first().n_docs, r.totals().first().n_tokens) == (3, 12) and r.batches() == ["a", "b", "c"]


def test_und_is_for_texts_without_a_letter(spark):
    data = [(i, w, lang) for i, (w, lang) in enumerate([("der die das und ist", "de"), ("the and of was this", "en")] * 20)]
    detect = language.detector(spark, language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), bits=12))
    odd = ["\u00b2", "\u00bd \u00be", "\u2167", "12 34", "!!", "", None, "\u00aa", "the"]
    got = [r.p.lang_pred for r in spark.createDataFrame([(t,) for t in odd], "text string").select(detect("text").alias("p")).collect()]
    assert got[:7] == ["und"] * 7 and "und" not in got[7:]


def _subword_forward(model, text):
    """The model as it is defined: an average of bucket vectors, then a softmax; nothing folded, nothing cached."""
    from collections import Counter

    from switchyard.llm.subword import ngram_buckets, tokens

    known, emb, soft = model.parts
    at = {int(b): k for k, b in enumerate(known)}
    total, n = np.zeros(model.dim), 0.0
    for word, count in Counter(tokens(text)).items():
        for bucket in ngram_buckets([word], model.sizes, model.bits)[0]:
            n += count**0.5
            if int(bucket) in at:
                total += count**0.5 * emb[at[int(bucket)]].astype(float)
    z = ((total / (n + model.smooth) if n else total) @ soft.astype(float) + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_equal_an_unfolded_forward_pass(spark, labels, rows):
    from switchyard.llm.subword import WordRows

    texts = [t for _, t, *_ in rows]
    model = toxicity.fit(labels.select("doc_id", "text"), labels, "toxic", 3, 1, bits=14, steps=200)
    small = model.proba(model.logits(texts, WordRows(model.rows, 50)))  # a cache that overflows
    assert np.allclose(small, [_subword_forward(model, t) for t in texts], atol=1e-5)

    tongue = language.fit(spark.createDataFrame([(i, w, lang) for i, (w, lang) in enumerate([("der die das und ist", "de"), ("the and of was this", "en")] * 20)], "doc_id long, text string, lang string"), bits=12).model
    assert np.allclose(tongue.proba(tongue.logits(texts, WordRows(tongue.rows, 50))), [_subword_forward(tongue, t) for t in texts], atol=1e-5)

    q = quality.fit(labels.select("doc_id", "text"), labels, epochs=5)

    def forward(text):
        words = quality.TOKEN.findall(text or "")
        index = [quality.index_vectors([w], q.dim)[0].astype(float) for w in words]
        bound = [sum((a * b for a, b in zip(index, index[k:], strict=False)), np.zeros(q.dim)) for k in quality.LAGS]
        x = np.concatenate([sum((q.word_vectors([w])[0].astype(float) for w in words), np.zeros(q.dim)), *bound]) / max(len(words), 1)
        return 1 / (1 + np.exp(-(np.maximum(x @ q.w1 + q.b1, 0) @ q.w2 + q.b2) / q.temperature))

    short = [t for t in texts if not t or len(t) < 20_000]
    whole = q.scores(short, WordRows(q.index_rows, 50))
    piece, quality.PIECE = quality.PIECE, 7  # pieces add up to the whole
    try:
        assert np.allclose(q.scores(short, WordRows(q.index_rows, 50)), whole)
    finally:
        quality.PIECE = piece
    assert np.allclose(q.scores(short, WordRows(q.index_rows, 50)), [forward(t) for t in short], atol=1e-4)
    assert 0.06 < q.temperature < 19  # not at an end of its grid


def test_embedding_estimates_are_unbiased_and_bounded():
    """Over many rotations the mean estimate is the cosine; the bound holds."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 64))
    b = 0.97 * a / np.linalg.norm(a) + 0.25 * b / np.linalg.norm(b)
    u = np.vstack([a, b]) / np.linalg.norm([a, b], axis=1, keepdims=True)
    errors, spreads, seed = [], [], embedding_dedup.SEED
    try:
        for k in range(300):
            embedding_dedup.SEED = 1000 + k
            embedding_dedup.rotations.cache_clear()
            embedding_dedup.dither.cache_clear()
            code, factor, ints, low, step = embedding_dedup.encode(u)
            signs = np.unpackbits(code, axis=1)[:, :64].astype(float) * 2 - 1
            errors.append((signs[0] @ (ints[1] * step[1] + low[1])) / (8 * factor[0]) - u[0] @ u[1])
            spreads.append(np.sqrt((1 - factor[0] ** 2) / factor[0] ** 2 * (1 - (u[0] @ u[1]) ** 2) / 63 + (step[1] / 2 / factor[0]) ** 2))
    finally:
        embedding_dedup.SEED = seed
        embedding_dedup.rotations.cache_clear()
        embedding_dedup.dither.cache_clear()
    assert abs(np.mean(errors)) < 3.5 * np.std(errors) / 300**0.5 and np.max(np.abs(errors) / spreads) < embedding_dedup.EPSILON

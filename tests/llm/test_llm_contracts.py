"""Every column of the registered queries against plain Python, the pipeline as it runs, and the
cases that hashes, penalties and limits must stand."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, brute_components, brute_counts, brute_spans, shingles

from decilens.llm import langid, minhash_dedup, packing, pieces, quality, queries, secrets, shard, toxicity
from decilens.llm._bytes import LOWER, hashed, same, slices

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


#: Words that a polynomial hash with an odd base takes for one.
ONE = thue_morse(4096)
TWO = ONE.translate(str.maketrans("ab", "ba"))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


# ---------------------------------------------------------------- hashes


def test_hashes_and_comparisons():
    rng = random.Random(3)
    words = ["".join(rng.choices("ab", k=n)) for n in (0, 1, 7, 8, 9, 63, 64, 65, 300) for _ in range(20)] + [ONE, TWO]
    (part,) = slices(pa.array(words), 1 << 30)
    data, a, b = part.data(LOWER), part.off[:-1], part.off[1:]
    for seed in (0, 1):
        assert len(set(hashed(data, a, b, seed).tolist())) == len(set(words))
    assert (hashed(data, a, b, 0) != hashed(data, a, b, 1)).all()
    i = np.repeat(np.arange(len(words)), len(words))
    j = np.tile(np.arange(len(words)), len(words))
    assert same(data, a[i], b[i], data, a[j], b[j]).tolist() == [words[x] == words[y] for x, y in zip(i, j, strict=True)]


def test_complementary_words_stay_apart(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [ONE, TWO, f"{ONE}\n{TWO}", " ".join([ONE, TWO] * 12), f"{ONE} one\n{TWO} two\n{ONE} one"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts, 1)], SCHEMA)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df.where("doc_id < 3")).collect()} == {1: 1, 2: 2}
    for r in quality.quality_rules(df).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute_counts(r.text)
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_decode(df, path, ids=True).collect():
        ids = lib.encode(texts[r.doc_id - 1], add_eos=True)
        assert list(r.ids) == ids and r.decoded == lib.decode(ids)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for r in packing.token_pieces(df, path).where("start = 0").collect():
        ids = np.array(tok.encode(texts[r.doc_id - 1], add_special_tokens=False).ids + [2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[: r.length].tobytes())


def test_a_slot_with_other_bytes_is_not_believed(monkeypatch):
    import public_tokenizers

    nothing = lambda data, start, end, seed=0: np.zeros(len(start), np.uint64)
    texts = pa.array(["one two three one", "four", "", "five one"])
    monkeypatch.setattr(packing, "hashed", nothing)
    coder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for part in slices(texts):
        ids, limits = coder.encode(part)
        for i in range(part.n):
            assert ids[limits[i] : limits[i + 1]].tolist() == coder.tokenizer.encode(part.text(i).decode(), add_special_tokens=False).ids
    monkeypatch.setattr(pieces, "hashed", nothing)
    codec = pieces.ChunkCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for part in slices(texts):
        lists, places = codec.chunks(part, 3)
        found = codec.segment([c for chunks in lists for c in chunks])
        ids = [b"".join(b"%d " % i for i in x) for x, _ in found]
        for i in range(part.n):
            assert codec.join(places[i], np.array([len(x) for x, _ in found]), ids, np.zeros(len(ids), bool), True) == codec.whole(part.text(i).decode())


def test_a_tokenizer_with_other_rules_is_used_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = packing.WordEncoder(path)
    assert not coder.separable and packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).separable
    for part in slices(pa.array(["Two  words\n", "", "it's 42"])):
        ids, limits = coder.encode(part)
        for i in range(part.n):
            assert ids[limits[i] : limits[i + 1]].tolist() == coder.tokenizer.encode(part.text(i).decode(), add_special_tokens=False).ids


# ---------------------------------------------------------------- op1


def test_op1_query(spark, rows):
    want = brute_components((r.doc_id, r.text) for r in rows.values())
    for r in queries.op1_minhash_dedup(spark, SF).collect():
        assert r.n_shingles == len(shingles(rows[r.doc_id].text)) and r.component_id == want[r.doc_id][1] and r.kept == (r.doc_id == r.component_id)


def test_a_loose_cluster_and_hot_keys(spark, monkeypatch):
    """Nodes that share buckets with one leader but mostly not each other, with every limit low."""
    from decilens.llm import _io

    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(_io, "LEAST_HOT", 8)
    monkeypatch.setattr(_io, "HOT_KEYS", 50)
    rng = random.Random(9)
    core = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(400):
        words = list(core)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(50)}"
        texts.append((i, " ".join(words)))
    texts += [(1000 + i, " ".join(core)) for i in range(60)]
    want = brute_components(texts)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), bands=60, rows=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}


# ---------------------------------------------------------------- op2


def test_op2_query(spark, rows):
    got = queries.op2_jump_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    key = {r.doc_id: r.k for r in spark.createDataFrame([(d,) for d in rows], "doc_id long").select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("k")).collect()}

    def jump(k, n):
        """Each growth from j to j + 1 shards moves the key with probability 1 / (j + 1)."""
        k, b, j = k % 2**64, -1, 0
        while j < n:
            b = j
            k = (k * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((k >> 33) + 1)))
        return b

    for r in got:
        raw = (rows[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == jump(key[r.doc_id], 40) and r.grown_shard == jump(key[r.doc_id], 41)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_of_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (5, "c"), (5, "c"), (6, None)], "doc_id long, text string")
    got = shard.assign_shards(df, shards=1, tie="text").collect()
    assert sorted(r.slot for r in got) == [0, 1, 2, 3, 4] and {r.shard for r in got} == {0}


# ---------------------------------------------------------------- op3


def test_op3_query(spark, rows):
    for r in queries.op3_adaptive_quality(spark, SF).collect():
        want = brute_counts(rows[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


def test_limits_follow_the_habits_of_a_source(spark):
    rng = random.Random(6)

    def text(source, i, outlier=None):
        long = source == "long"
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(8, 12) if long else rng.randrange(3, 6))) for _ in range(rng.randrange(380, 420))]
        if outlier == "word_length":
            words = ["y" * 40 + w for w in words]
        lines = [" ".join(words[j : j + 20]) for j in range(0, len(words), 20)]
        symbols = rng.randrange(20, 41) if long else 0
        if outlier == "symbols":
            symbols = 900
        # the habit of "long": a footer of three words given several times
        footer = [f"see page {i}"] * (rng.randrange(2, 8) if long else 0)
        if outlier == "dup_lines":
            footer = [f"s{i}"] * 60
        again = lines[:1] if long else []
        if outlier == "repeats":
            again = [" ".join(w + "q" * (k == 0) for k, w in enumerate(lines[n].split())) for n in (0, 1)]
        return "\n".join(lines + again + footer) + " " + "#" * symbols

    data, odd = [], {}
    for s, source in enumerate(("long", "short")):
        data += [(s * 1000 + i, text(source, i), "en", source, 0) for i in range(200)]
        for m, metric in enumerate(quality.METRICS):
            data.append((s * 1000 + 500 + m, text(source, 500 + m, metric), "en", source, 0))
            odd[s * 1000 + 500 + m] = metric
    df = spark.createDataFrame(data, SCHEMA)
    bounds = quality.limits(quality.sketch(quality.quality_rules(df).select("lang", "source", "base_failed", *quality.COUNTS)), 100, 3.0).collect()
    high = {(r.source, r.metric): r.high for r in bounds}
    assert len(high) == 8
    for m in quality.METRICS:
        assert high["long", m] != high["short", m]
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert all(got[d].kept for d in got if d not in odd)
    assert {d for d in odd if not got[d].kept} >= {d for d in odd if odd[d] in ("symbols", "dup_lines", "word_length") or d >= 1000}


def test_limits_of_null_groups_and_ties(spark):
    same_text = " ".join(f"word{i}" for i in range(50))
    rows = [(i, same_text, None, None if i % 2 else "s", 0) for i in range(300)]
    assert quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).where("not kept").count() == 0


# ---------------------------------------------------------------- op4 and op7


def correlated():
    """Toxic texts that mostly name a group, beside neutral ones that do so less often."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(5, 40))]
        toxic = i % 4 == 0
        if toxic and rng.random() < 0.8:
            words.append(rng.choice(["vileish", "vilesome", "grotty"]))
        if rng.random() < (0.9 if toxic else 0.05):
            words.append(rng.choice(["muslims", "jews", "christians", "hindus", "buddhists", "atheists"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_the_penalty_takes_the_weight_of_group_names(spark):
    data = spark.createDataFrame(correlated(), "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(1, "word1 muslims word2"), (2, "word1 jews word2"), (3, "word1 vileish word2")], "doc_id long, text string")
    scores = {}
    for penalty in (0.0, 1.0):
        model = toxicity.train(data, counterfactual=penalty)
        scores[penalty] = {r.doc_id: r.score for r in toxicity.score(neutral, model).collect()}
    assert scores[0.0][1] > 0.5 and scores[0.0][2] > 0.5  # without it the names carry the label
    assert scores[1.0][1] < 0.3 and scores[1.0][2] < 0.3 and scores[1.0][3] > 0.9


def test_rows_of_the_fit(spark):
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(4000)] + [(5, 0), (5, None), (None, 1), (3999, 7), (3999, 1)], "doc_id long, toxic int")
    got = toxicity.bounded(labels, 800).collect()
    n = Counter(r.toxic for r in got)
    assert {r.doc_id: r.toxic for r in got}[5] == 1 and n[1] == 301 and 400 < n[0] < 600 and len({r.doc_id for r in got}) == len(got)
    assert toxicity.bounded(labels.where("toxic = 7"), 10).count() == 0


def test_op4_and_op7_queries(spark, rows):
    model = queries.toxicity_model(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def features(text):
        for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            for n in (0, *[n for n in toxicity.HEADS if n < len(w)]):
                raw = np.frombuffer((w[:n] if n else w).encode() + b"\0" * 8, np.uint8)
                yield int(hashed(raw, np.array([0]), np.array([len(raw) - 8]), n)[0])

    got = queries.op4_counterfactual_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got[:60]:
        z = model.bias + sum(weights.get(h, 0.0) for h in set(features(rows[r.doc_id].text)))
        assert r.held_out == held(r.doc_id) and abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.7)

    langs = langid.train(spark.read.parquet(f"{SF}/documents.parquet").where(~queries.held_out() & F.col("lang").isNotNull()).select("lang", "text"))
    out = {r.doc_id: r for r in queries.op7_mixture_langid(spark, SF).collect()}
    for i, (d, row) in enumerate(rows.items()):
        assert out[d].held_out == held(d) and 0 <= out[d].score <= 1
        if i % 5 == 0:  # a text by itself has the result it has beside others
            (part,) = slices(pa.array([row.text or ""]), 1 << 40)
            share = langid.infer(part, langs, 8, 2.0)[0][0]
            assert out[d].lang_pred == langs.langs[int(np.argmax(share))] and abs(out[d].score - share.max()) < 1e-5


# ---------------------------------------------------------------- op5 and op6


def test_op6_query(spark, rows):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.op6_distinct_chunks(spark, SF).collect():
        ids = lib.encode(rows[r.doc_id].text or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_each_chunk_is_segmented_once_for_all_blocks(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma\ndelta", i) for i in range(500)], "doc_id long, text string, ids int").repartition(5)
    out = pieces.encode_decode(df, path)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.select("ids_sha256").distinct().count() == 7
    assert sorted(r.doc_id for r in out.collect()) == list(range(500))


# ---------------------------------------------------------------- op8


def brute_markov(text, weights, total=20.0, each=0.5):
    place = {c: i for i, c in enumerate(secrets.ALPHABET)}
    base = [(m.start(), m.end()) for _, p, g, n in secrets.BASE for m in re.finditer(p, text) if len(m[g]) >= n]
    out = []
    for m in re.finditer(secrets.TOKEN % secrets.LEAST, text):
        s = sum(round(weights[place[a] * secrets.SIZE + place[b]], 6) for a, b in zip(m[0], m[0][1:], strict=False))
        if s >= max(total, each * (len(m[0]) - 1)) - 1e-9 and not any(a < m.end() and m.start() < b for a, b in base):
            out.append((m.start(), m.end()))
    return out


def redacted(text, spans):
    out, at = "", 0
    for a, b in sorted(spans):
        if out and a <= at:
            at = max(at, b)
            continue
        out, at = out + text[at:a] + "[SECRET]", b
    return out + text[at:]


def test_markov_spans_and_redaction_equal_brute_force(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    weights = secrets.train(secrets.default_samples(small))
    rng = random.Random(4)
    parts = ["password=", "secret: ", "AKIA", "deadbeef" * 3, "x", " ", "Q9zX7kLm2PpR4tVw8yBn", "a1B2c3D4e5F6g7H8i9J0k", "é", "\n", 'token="', "abcdefgh", "internationalization_support", "0123456789abcdef" * 2, "/", "="]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 30)))) for i in range(600)]
    rows.append((900, " é ".join(rng.choices(parts, k=3000))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = 0
    for r in secrets.scan_secrets(df, weights).collect():
        markov = brute_markov(r.text, weights)
        found += len(markov)
        assert [(s.start, s.end) for s in r.markov] == markov
    assert found > 100
    for r in secrets.redact(df, weights).collect():
        text = dict(rows)[r.doc_id]
        spans = brute_markov(text, weights) + [(m.start(), m.end()) for _, p, g, n in secrets.BASE for m in re.finditer(p, text) if len(m[g]) >= n]
        assert r.text == redacted(text, spans)


def test_op8_query(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    weights = secrets.train(secrets.default_samples(docs))
    for r in queries.op8_markov_secrets(spark, SF).collect():
        text = rows[r.doc_id].text or ""
        base = brute_spans(text)
        n = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        order = ("assign", "access", "hex", "markov")
        spans = [tuple(s.split(":")) for s in base.split(",") if s] + [("markov", a, b) for a, b in brute_markov(text, weights)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (int(s[1]), order.index(s[0]))))


def test_many_spans_in_one_text(spark):
    text = " x ".join("deadbeef%024x" % i for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    weights = [0.0] * secrets.SIZE**2
    r = secrets.scan_secrets(df, weights).select(F.size("hex").alias("n"), F.element_at("hex", -1).alias("last")).first()
    assert r.n == 40_000 and (r.last.start, r.last.end) == (len(text) - 32, len(text))
    assert secrets.redact(df, weights).first().text == " x ".join(["[SECRET]"] * 40_000)


# ---------------------------------------------------------------- op9, op10, pipeline


def test_op9_and_op10_queries(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {d: np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for d, r in rows.items()}
    out, at = {}, {}
    for r in queries.op9_bin_slack_packing(spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        out.setdefault(r.doc_id, []).append((r.start, r.length))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, whole in [(out[d], len(i)) for d, i in ids.items()] + [(s, None) for s in at.values()]:
        reach = 0
        for a, n in sorted(spans):
            assert a == reach
            reach += n
        assert reach == whole if whole is not None else reach <= 4096

    order = sorted(rows)
    for r in queries.op10_closed_syncmers(spark, SF).collect():
        text, nxt = rows[r.doc_id].text, rows[order[(order.index(r.doc_id) + 1) % len(order)]].text
        m = len(text) // 4
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - m] + nxt[:m]).encode()).hexdigest()
        assert len(r.fingerprint) % 16 == 0 and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    assert len(queries.QUERIES) == 10 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token = "q7Zk2Lx9VbT4mNc8RwY1pHs6JdF3gKa0"
    extra = docs.orderBy("doc_id").limit(1).select((F.col("doc_id") + 10**6).alias("doc_id"), F.concat("text", F.lit(f" {token} password=abcdefgh")).alias("text"), "lang", "source", "n_chars")
    sf = str(tmp_path / "sf")
    docs.unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    got = corpus_pipeline.run(spark, sf).collect()

    now = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(now, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = now.join(toxicity.score(now, model).where("predicted = 0").select("doc_id"), "doc_id")
    langs = langid.identify(clean, queries.language_model(clean), fit=True).where("lang_pred <> 'und' and score >= 0.4 and fits").collect()
    want = brute_components((r.doc_id, r.text) for r in langs)
    kept = sorted(d for d, (_, c) in want.items() if c == d)
    assert sorted({r.doc_id for r in got}) == kept and len(kept) > 100
    totals = Counter()
    for r in got:
        totals[r.sequence_id] += r.length
    assert max(totals.values()) <= 4096

    stage = dict(corpus_pipeline.STAGES)
    hidden = stage["secrets"](spark, now, sf)
    assert hidden.columns == now.columns and hidden.where(f"text like '%{token}%'").count() == 0
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, now.limit(0), sf).count() == 0, name
    wider = now.withColumn("score", F.lit("x")).withColumn("__h", F.lit(1)).withColumn("kept", F.lit(True))
    assert stage["near_dedup"](spark, wider, sf).columns == wider.columns

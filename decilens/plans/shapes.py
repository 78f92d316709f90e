"""Registered queries: shapes of questions, answers, rankings and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from decilens import tables as T
from decilens.functions import text as X
from decilens.operators import cohort, dense, planning, shaping
from decilens.plans.ctes import TOKEN
from decilens.plans.queries import _VC, _VQ, _vec, kept, qdec, query, ranked, results
from decilens.sources import results as stored


def _pick(values, key="doc_id"):
    """One of the literal values by the key's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _labels(spark, sf_dir):
    return T.read(spark, sf_dir, "labels").select("doc_id").distinct()


def _cases(raw: list[str], *expected: str) -> str:
    """SQL of the expected values of the literals that ``_pick`` gives."""
    return ", ".join(f"({i}, {e})" for i, e in enumerate(expected[: len(raw)]))


_ALIASES = ['["Paris", "City of Paris", "Paris"]', "['Lyon', ' Lyon ', '']", "Nice", "", "[1.5, nan, None, 'x']", '["say \\"no\\"", "a, b"]']
_ALIAS_WANT = ("['Paris', 'City of Paris']", "['Lyon']", "['Nice']", "[]::varchar[]", "['1.5', 'x']", "['say \\\"no\\\"', 'a, b']")


@query(f"select doc_id, len(v) n, coalesce(v[1], '') a1, coalesce(v[2], '') a2 from (select distinct doc_id from labels) join (values {_cases(_ALIASES, *_ALIAS_WANT)}) t(i, v) on i = doc_id % 6")
def parsed_aliases(spark, sf_dir):
    v = _labels(spark, sf_dir).select("doc_id", shaping.aliases(_pick(_ALIASES)).alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("n"), F.coalesce(F.get("v", F.lit(0)), F.lit("")).alias("a1"), F.coalesce(F.get("v", F.lit(1)), F.lit("")).alias("a2"))


_LISTS = ["[12, 7.0, nan]", "['4', 'none', '5']", "", "[]"]


@query(f"select doc_id, v ids from (select distinct doc_id from labels) join (values {_cases(_LISTS, '[12, 7]', '[4, 5]', '[]::bigint[]', '[]::bigint[]')}) t(i, v) on i = doc_id % 4")
def parsed_id_lists(spark, sf_dir):
    ids = F.transform(shaping.listed(_pick(_LISTS)), lambda x: x.cast("double").cast("long"))
    return _labels(spark, sf_dir).select("doc_id", ids.alias("ids"))


_ANSWERS = ['{"text": " Rome ", "answer": "x"}', '{"answer": "Oslo"}', '{"value": 7}', " plain ", '{"other": 1}']


@query(f"select doc_id, v answer from (select distinct doc_id from labels) join (values {_cases(_ANSWERS, chr(39) + 'Rome' + chr(39), chr(39) + 'Oslo' + chr(39), chr(39) + '7' + chr(39), chr(39) + 'plain' + chr(39), 'null')}) t(i, v) on i = doc_id % 5")
def answer_texts(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", shaping.answer_text(_pick(_ANSWERS)).alias("answer"))


@query("select question_id, list_distinct_in_order answers from (select question_id, list_filter([dataset, 'x'] || answer_texts || [dataset], lambda v, i: list_position([dataset, 'x'] || answer_texts || [dataset], v) = i) list_distinct_in_order from question)", "question")
def extra_answers(spark, sf_dir):
    q = T.question(spark, sf_dir)
    others = F.concat(F.array(F.lit("x")), "answer_texts", F.array("dataset"))
    return q.select("question_id", shaping.with_extra_answers(F.col("dataset"), others).alias("answers"))


@query(
    """select conv_id id, t wikipedia_id, answers from (select conv_id, list_sort(list_distinct(list(turn))) ts, len(list_distinct(list(role))) answers from conversations where conv_id is not null group by 1), unnest(ts) u(t)"""
)
def provenance_rows(spark, sf_dir):
    turns = T.read(spark, sf_dir, "conversations").where("conv_id is not null")
    one = F.struct(F.col("role").alias("answer"), F.array(F.struct(F.col("turn").alias("wikipedia_id"))).alias("provenance"))
    examples = turns.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(one).alias("output"))  # the turns of a conversation
    return shaping.provenance(examples).select("id", "wikipedia_id", F.size("answers").cast("long").alias("answers"))


@query(
    "select id, case when id % 3 = 0 then decile when id % 3 = 1 then (id % 7)::int else -1 end decile, llm llm_key, dataset from ev", "ev",
)
def metadata_columns(spark, sf_dir):
    r = results(spark, sf_dir)
    own = F.when(F.col("id") % 3 == 0, F.col("decile"))
    other = F.when(F.col("id") % 3 == 1, (F.col("id") % 7).cast("int"))
    raw = F.to_json(F.struct(own.alias("decile"), other.alias("decile_chunk_weighted"), F.col("llm").alias("llm_key"), "dataset"))
    return r.select("id", raw.alias("raw")).select("id", *shaping.metadata_columns(F.col("raw"), "decile", "llm_key", "dataset"))


@query("select id, map_from_entries([{'k': 'a', 'v': case when id % 2 = 0 then 'own' else llm end}, {'k': 'b', 'v': backend}])['a'][1] a, backend b from ev".replace("map_from_entries([{'k': 'a', 'v': case when id % 2 = 0 then 'own' else llm end}, {'k': 'b', 'v': backend}])['a'][1]", "case when id % 2 = 0 then 'own' else llm end"), "ev")
def filled_metadata(spark, sf_dir):
    known = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("a"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    full = shaping.filled_metadata(known, F.create_map(F.lit("a"), "llm", F.lit("b"), "backend"))
    return results(spark, sf_dir).select("id", full.alias("m")).select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


_SCORES = ["true", " No ", "1", "0.25", "odd"]


@query(
    "select id, v score, length(backend || '  x') n_chars, 2 n_words, case when id % 3 = 0 then null else id % 3 = 1 end hit from ev join (values (0, 1.0), (1, 0.0), (2, 1.0), (3, 0.25), (4, null)) t(i, v) on i = id % 5",
    "ev", d="score",
)
def normalised_results(spark, sf_dir):
    r = results(spark, sf_dir).select("id", F.concat("backend", F.lit("  x")).alias("answer"), _pick(_SCORES, "id").alias("score"), F.col("id").alias("gold"))
    ids = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).when(F.col("id") % 3 == 1, F.array(F.concat(F.col("id").cast("string"), F.lit(".0")))).otherwise(F.array(F.lit("x")))
    return shaping.normalised(r.withColumn("retrieved_ids", ids)).select("id", "score", "n_chars", "n_words", "hit")


@query(
    "select question_id, case when p > 0 then 1.0 / p else 0 end mrr, (p > 0)::int::double recall from (select question_id, coalesce(list_position(list(r.wikipedia_id order by doc_rank)[1:5], any_value(q.wikipedia_id)), 0) p from ranked r join question q using (question_id) group by 1)",
    "ranked", "question", d="mrr recall",
)
def single_query_metrics(spark, sf_dir):
    n = stored.nested(ranked(spark, sf_dir), 10).join(T.question(spark, sf_dir).select("question_id", "wikipedia_id"), "question_id")
    return n.select("question_id", *[shaping.query_metric(F.col("topk_ids"), F.col("wikipedia_id"), m, 5).alias(m) for m in ("mrr", "recall")])


@query("select question_id, doc_rank position, wikipedia_id, score from ranked where doc_rank < 3", "ranked", d="score")
def exploded_rankings(spark, sf_dir):
    n = stored.nested(ranked(spark, sf_dir), 10)
    return shaping.exploded(n, 3, "topk_ids", "topk_scores").select("question_id", "position", F.col("topk_ids").alias("wikipedia_id"), F.col("topk_scores").alias("score"))


@query("select question_id, doc_rank, case when m <= 1 then 1 - score else 1 / (1 + score) end auto, 1 - score linear, 1 / (1 + score) inverse from (select *, max(score) over (partition by question_id) m from ranked)", "ranked", d="auto linear inverse")
def score_distances(spark, sf_dir):
    from pyspark.sql import Window as W

    r = ranked(spark, sf_dir).withColumn("m", F.max("score").over(W.partitionBy("question_id")))
    return r.select("question_id", "doc_rank", *[shaping.distance(F.col("score"), m, F.col("m")).alias(m) for m in ("auto", "linear", "inverse")])


@query(
    "select name, bytes, bytes <= 0.8 * 30000000 fits from (select count(*) n, any_value(len(embedding)) d from embeddings), lateral (select unnest(['flat', 'graph', 'ivf_flat', 'ivf_pq']) as name, unnest([n * d * 4, n * (d * 4 + 256), n * (d * 4 + 8), n * 72]) bytes)"
)
def index_plan(spark, sf_dir):
    n, d = T.vectors(spark, sf_dir).agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return spark.createDataFrame(planning.index_plan(n, d, 30_000_000), "name string, bytes long, fits boolean")


@query("select question_id, 'query: ' || question_text query, 'passage: ' || dataset passage from question", "question")
def prefixed_texts(spark, sf_dir):
    return T.question(spark, sf_dir).select("question_id", X.prefixed(F.col("question_text"), "query").alias("query"), X.prefixed(F.col("dataset"), "passage").alias("passage"))


@query(f"select wikipedia_id, length(text) n_chars, len(string_split_regex(trim(text), '\\s+')) n_words, len(regexp_extract_all(lower(text), '{TOKEN}')) n_tokens, length(text[1:2000]) n_kept from article", "article")
def text_lengths(spark, sf_dir):
    t = F.col("text")
    return T.article(spark, sf_dir).select(
        "wikipedia_id", F.length(t).alias("n_chars"), F.size(F.split(F.trim(t), r"\s+")).cast("long").alias("n_words"), F.size(X.tokens(t)).cast("long").alias("n_tokens"), F.length(F.substring(t, 1, 2000)).alias("n_kept")
    )


@query("select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, role, text) as body from (select * from conversations where conv_id is not null and text is not null) group by conv_id")
def joined_paragraphs(spark, sf_dir):
    turns = T.read(spark, sf_dir, "conversations").where("conv_id is not null and text is not null")
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))  # the turns of a conversation
    return parts.select("conv_id", F.array_join(F.col("p.text"), "\n").alias("body"))


_NAMES = ["router60k_mrr20.pt", "router_Recall5.pt", "answer_router.pt", "plain.pt"]


@query("select doc_id, v kind from (select distinct doc_id from labels) join (values (0, 'mrr'), (1, 'recall'), (2, 'answer'), (3, 'unknown')) t(i, v) on i = doc_id % 4")
def router_kinds(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", shaping.router_kind(_pick(_NAMES)).alias("kind"))


@query(f"select term, count(*) n from (select unnest(regexp_extract_all(strip_accents(lower(text)), '{TOKEN}')) term from article) group by term having count(*) > 5", "article")
def accent_free_terms(spark, sf_dir):
    words = T.article(spark, sf_dir).select(F.explode(X.tokens(shaping.plain_letters(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


_IDS = [" 12.0 ", "7", "x.0", "3.05"]


@query("select doc_id, v id from (select distinct doc_id from labels) join (values (0, '12'), (1, '7'), (2, 'x'), (3, '3.05')) t(i, v) on i = doc_id % 4")
def clean_ids(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", X.clean_id(_pick(_IDS)).alias("id"))


@query("select question_id, length(a.text) n_gold, a.text[1:40] head from question q left join article a using (wikipedia_id)", "question", "article")
def questions_with_gold_text(spark, sf_dir):
    texts = T.article(spark, sf_dir).select("wikipedia_id", "text")
    return T.question(spark, sf_dir).join(texts, "wikipedia_id", "left").select("question_id", F.length("text").alias("n_gold"), F.substring("text", 1, 40).alias("head"))


@query("select question_id, 5000.0 / count(*) over () latency_ms from question", "question", d="latency_ms")
def even_latency(spark, sf_dir):
    return planning.split_time(5.0, T.question(spark, sf_dir))


@query("select wikipedia_id, popularity_avg from (select *, row_number() over (partition by wikipedia_id order by source, popularity_avg) rn from article where popularity_avg is not null) where rn = 1", "article", d="popularity_avg")
def popularity_lookup(spark, sf_dir):
    return cohort.first_rows(T.article(spark, sf_dir).where("popularity_avg is not null"), 1, "wikipedia_id", order=["source", "popularity_avg"]).select("wikipedia_id", "popularity_avg")


@query("select question_id, r.wikipedia_id, coalesce(d.decile, -1) decile from ranked r left join (select wikipedia_id, any_value(decile) decile from qdec group by 1) d using (wikipedia_id)", "ranked", "qdec")
def decile_lookup(spark, sf_dir):
    known = qdec(spark, sf_dir).select("wikipedia_id", "decile").dropDuplicates(["wikipedia_id"])
    return ranked(spark, sf_dir).join(known, "wikipedia_id", "left").select("question_id", "wikipedia_id", F.coalesce("decile", F.lit(-1)).alias("decile"))


@query("select question_id from question where dataset = 'en' except all select question_id from question where wikipedia_id % 2 = 0", "question")
def cohort_difference(spark, sf_dir):
    q = T.question(spark, sf_dir)
    return q.where("dataset = 'en'").select("question_id").exceptAll(q.where("wikipedia_id % 2 = 0").select("question_id"))


@query("select question_id, dataset, 'a' part from question where wikipedia_id % 2 = 0 union all select question_id, dataset, 'b' from question where wikipedia_id % 3 = 0", "question")
def frames_union(spark, sf_dir):
    q = T.question(spark, sf_dir).select("question_id", "dataset")
    a, b = (T.question(spark, sf_dir).where(f"wikipedia_id % {n} = 0").select("question_id", "dataset", F.lit(p).alias("part")) for n, p in ((2, "a"), (3, "b")))
    assert cohort.same_cohort(q, q)
    return a.unionByName(b)


_KNN = "select question_id, wikipedia_id, score from (select *, row_number() over (partition by question_id order by round(score, 9), wikipedia_id) rn from (select question_id, wikipedia_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - v[i]) * (q[i] - v[i]))) score from vq, vc where own <> wikipedia_id)) where rn <= 276"


@query("select question_id, wikipedia_id, score, (rn - 1)::int doc_rank from (select *, row_number() over (partition by question_id order by round(score, 9), wikipedia_id) rn from near where wikipedia_id % 3 <> 0) where rn <= 10", d="score", vq=_VQ, vc=_VC, near=_KNN)
def dense_with_store(spark, sf_dir):
    """Neighbours that the document store knows: 2k + 256 are fetched, ids without a row go."""
    q, c = _vec(spark, sf_dir)
    return dense.stored_search(q, c, c.where("wikipedia_id % 3 <> 0").select("wikipedia_id"), 10)


@query("select 10 k, avg(case when list_contains(b, id) then 1.0 else 0.0 end) recall from (select unnest(list(wikipedia_id)) id, list(wikipedia_id) b from near group by question_id)", d="recall", vq=_VQ, vc=_VC, near=_KNN)
def exact_recall(spark, sf_dir):
    """An exact search against itself: recall 1, as a check of the measure."""
    q, c = _vec(spark, sf_dir)
    near = kept(spark, (sf_dir, "exact"), lambda: dense.search(q, c, 10))
    return dense.recall(near, near, (10,))


@query("select id, split from (select doc_id id, case when ('0x' || md5('42:q' || doc_id)[1:6])::int < 0.9 * 16777216 then 'train' else 'test' end split from (select distinct doc_id from labels))")
def question_split(spark, sf_dir):
    ids = _labels(spark, sf_dir).withColumn("question_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    return cohort.hash_split(ids).select(F.col("doc_id").alias("id"), "split")


_MARKED_UP = (
    "<!-- a\nb -->{{box|{{inner}}|x}}[[File:a.png|thumb|see [[the link|display]] and [[other]]]]\n'''Bold''' [[page|shown]] and [[plain]]<ref name=\"x\">note</ref><ref name=y />\n"
    "== Head ==\n[http://x.org/a some words] [http://y.org]\n#REDIRECT [[x]]\n----\n| cell\n! head\n* item <b>tag</b>\n\n\n\n"
)


def _wiki_sql(raw: str) -> str:
    """The passes in DuckDB, whose patterns cannot look ahead: openings of file blocks are masked."""
    step = lambda t, p, r, f="g": f"regexp_replace({t}, '{p}', '{r}', '{f}')"
    t = step(step(step(step(raw, "<!--.*?-->", "", "gs"), "<ref[^>]*>.*?</ref>", "", "gis"), r"<ref[^/]*/\s*>", "", "gi"), "<[^>]+>", "", "gs")
    for _ in range(3):
        t = step(t, r"\{\{[^{}]*\}\}", "")
    t = step(t, r"\[\[((?:File|Image|Media):)", r"\x{1}\1", "gi").replace(r"\x{1}\1", "\x01\\1")
    for _ in range(3):
        t = step(t, r"\[\[([^\[\]\x01|]*\|)?([^\[\]\x01]+)\]\]", r"\2")
    for _ in range(3):
        t = step(t, r"\x01[^\[\]\x01]*\]\]", "")
    for p, r in ((r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"), (r"\[https?://[^\]]+\]", ""), (r"''''{2,3}".replace("''''", "(?:'''')").replace("(?:''''){2,3}", "(?:''){2,3}"), "")):
        t = step(t, p, r)
    for p, r, f in ((r"^=+\s*(.*?)\s*=+\s*$", r"\1", "gm"), (r"^#REDIRECT.*$", "", "gim"), (r"^-{4,}\s*$", "", "gm"), (r"^\s*[|!].*$", "", "gm"), (r"^[;:*#]+\s*", "", "gm"), (r"\n{3,}", "\n\n", "g")):
        t = step(t, f"(?{f.replace('g', '')}){p}" if f != "g" else p, r)
    return step(t, r"^\s+|\s+$", "")


@query(f"select conv_id, turn, md5({_wiki_sql('raw')}) h from (select conv_id, turn, '{_MARKED_UP.replace(chr(39), chr(39) * 2)}' || coalesce(text, '') raw from conversations)")
def wiki_clean(spark, sf_dir):
    turns = T.read(spark, sf_dir, "conversations")
    raw = F.concat(F.lit(_MARKED_UP), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", F.md5(X.wiki_text(raw)).alias("h"))

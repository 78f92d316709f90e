"""The logical tables as SQL, from which oracle queries are put together."""

from __future__ import annotations

EDGE_STEPS = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
_STOP = "('" + "','".join("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()) + "')"


def terms_of(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{TOKEN}'), lambda w: w not in {_STOP})"


def decile_of(value: str, edges: str = "e") -> str:
    return f"list_sum(list_transform({edges}[2:10], lambda x: case when {value} >= x then 1 else 0 end))::int"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "pageviews": ((), "select l_returnflag source, l_partkey id, l_linestatus device, strftime(l_shipdate, '%Y%m') period, l_quantity::bigint views, l_shipdate at_ from lineitem"),
    "monthly": (("pageviews",), "select id, period, sum(views)::bigint views from pageviews group by id, period"),
    "popularity": (("monthly",), "select id, avg(views) popularity_avg, count(*) n_months from monthly group by id"),
    "article": (
        ("popularity",),
        "select d.doc_id wikipedia_id, d.text, d.lang dataset, d.source, p.popularity_avg, t.p_name wikipedia_title from documents d join popularity p on p.id = d.doc_id left join part t on t.p_partkey = d.doc_id",
    ),
    "edges": (("article",), f"select quantile_cont(popularity_avg, {EDGE_STEPS}) e from article where popularity_avg >= 0"),
    "dec": (("article", "edges"), f"select a.*, {decile_of('a.popularity_avg')} decile from article a, edges"),
    "question": (
        ("article",),
        f"""select 'q' || wikipedia_id question_id, array_to_string(t[1:12], ' ') question_text,
            list_filter(t, lambda w: length(w) >= 9)[1:2] answer_texts, wikipedia_id, popularity_avg, dataset
            from (select a.*, regexp_extract_all(lower(a.text), '{TOKEN}') t from article a join labels l on l.doc_id = a.wikipedia_id)""",
    ),
    "qdec": (("question", "edges"), f"select q.*, {decile_of('q.popularity_avg')} decile from question q, edges"),
    "chunk": (
        ("article",),
        "select wikipedia_id, (s / 900)::int chunk_id, substr(text, s + 1, 1000) chunk from (select wikipedia_id, text, unnest(range(0, greatest(length(text), 1), 900))::int s from article)",
    ),
    "chunk_tokens": (("chunk",), f"select wikipedia_id, chunk_id, {terms_of('chunk')} t from chunk"),
    "lens": (("chunk_tokens",), "select wikipedia_id, chunk_id, len(t) len from chunk_tokens"),
    "postings": (("chunk_tokens",), "select term, wikipedia_id, chunk_id, count(*) tf from (select wikipedia_id, chunk_id, unnest(t) term from chunk_tokens) group by all"),
    "terms": (("postings",), "select term, count(*) df from postings group by term"),
    "totals": (("lens",), "select count(*) n, avg(len) avg_len from lens"),
    "qterms": (("question",), f"select question_id, term, count(*) qtf from (select question_id, unnest({terms_of('question_text')}) term from question) group by all"),
}

IDF = {
    "lucene": "ln(1 + (n - df + 0.5) / (df + 0.5))",
    "robertson": "ln((n - df + 0.5) / (df + 0.5))",
    "atire": "ln(n / df::double)",
    "bm25l": "ln((n + 1) / (df + 0.5))",
    "bm25plus": "ln((n + 1) / df::double)",
}
_NORM = "(0.25 + 0.75 * len / avg_len)"
_PLAIN = f"tf / (1.5 * {_NORM} + tf)"
TF = {
    "lucene": _PLAIN,
    "robertson": _PLAIN,
    "atire": f"tf * 2.5 / (tf + 1.5 * {_NORM})",
    "bm25l": f"(2.5 * (tf / {_NORM} + 0.5) / (2.0 + tf / {_NORM}) - 0.625)",
    "bm25plus": _PLAIN,
}
ABSENT = {"lucene": "0.0", "robertson": "0.0", "atire": "0.0", "bm25l": "0.625", "bm25plus": "1.0"}


def ranked_cte(variant: str, k: int) -> str:
    return f"""select question_id, (rn - 1)::int doc_rank, wikipedia_id, chunk_id, score from (
      select *, row_number() over (partition by question_id order by round(score, 9) desc, wikipedia_id, chunk_id) rn from (
        select s.question_id, s.wikipedia_id, s.chunk_id, s.stored + a.absent score from
          (select q.question_id, p.wikipedia_id, p.chunk_id, sum(qtf * {IDF[variant]} * {TF[variant]}) stored
             from qterms q join terms t using (term) join postings p using (term) join lens l using (wikipedia_id, chunk_id), totals group by all) s
          join (select question_id, sum(qtf * {IDF[variant]} * {ABSENT[variant]}) absent from qterms join terms using (term), totals group by all) a using (question_id)))
      where rn <= {k}"""


_RANK_DEPS = ("qterms", "terms", "postings", "lens", "totals")
CTES["ranked"] = (_RANK_DEPS, ranked_cte("bm25plus", 10))
CTES["ranked_lucene"] = (_RANK_DEPS, ranked_cte("lucene", 10))
CTES["enriched"] = (
    ("ranked", "qdec", "article"),
    """select r.question_id, r.doc_rank, r.wikipedia_id, r.chunk_id, r.score, q.wikipedia_id gold, q.popularity_avg gold_pop, q.decile, q.dataset, a.popularity_avg pop,
       length(a.text) doc_len from qdec q join ranked r using (question_id) join article a on a.wikipedia_id = r.wikipedia_id""",
)
CTES["gold_rank"] = (("ranked", "qdec"), "select q.question_id, q.dataset, q.decile, min(case when r.wikipedia_id = q.wikipedia_id then r.doc_rank end) rank from qdec q left join ranked r using (question_id) group by all")
CTES["ev"] = (
    ("article", "edges"),
    f"""select l.doc_id id, case when l.doc_id % 2 = 0 then 'small' else 'large' end llm, (['bm25', 'dense', 'hybrid'])[(l.doc_id % 3 + 1)::int] backend,
        case when l.doc_id % 5 < 2 then 1 else 3 end ctx, l.quality::double score, l.toxic = 0 hit, a.dataset, a.popularity_avg,
        {decile_of('a.popularity_avg')} decile from labels l join article a on a.wikipedia_id = l.doc_id, edges""",
)


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` under the CTEs it names, with what those need, and ``extra`` ones after them."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for d in CTES[name][0]:
                visit(d)
            order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} as ({CTES[n][1]})" for n in order] + [f"{n} as ({s})" for n, s in extra.items()]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body

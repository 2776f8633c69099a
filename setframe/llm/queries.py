"""Registered queries of the corpus operators, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.llm import (bpe, divergence, embedding_join, exact_dedup, minhash_forest, mixing,
                           neighbours, packing, pii, quality, secret_scan, toxicity, vector_codes)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    return bpe.Vocabulary(spark, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


@query
def op9_bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(documents(spark, d), vocabulary(spark))


@query
def op8_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, d))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op8_exact_dedup"] = f"""
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(folded) as text_sha256
from (select doc_id, {_FOLDED} as folded from documents) t
window w as (partition by folded)"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")


@query
def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return toxicity.scored(docs, toxicity.learned_from(docs, labels(spark, d)))


@query
def op7_minhash_forest(spark: SparkSession, d: str) -> DataFrame:
    return minhash_forest.near_duplicates(documents(spark, d), threshold=85)


@query
def op4_quality_network(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return quality.scored(docs, quality.trained_on(docs, labels(spark, d)))


@query
def op2_personal_data(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return pii.personal_data(docs, pii.learned_from(docs))


@query
def op3_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, d))


MIXTURE = mixing.Mixture()


@query
def op1_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = mixing.probabilities(documents(spark, d), MIXTURE)
    return rows.withColumn("p", F.round("p", 9))


def _mixing_sql(mixture: mixing.Mixture) -> str:
    """The same arithmetic with one common table expression for every scaling."""
    topic = " ".join(f"when contains(text, '{mark}') then '{name}'"
                     for name, mark in mixing.TOPIC_MARKS)
    dims = mixing.DIMENSIONS
    parts = [f"""docs as (select doc_id, source, lang, coalesce(source, '{mixing.NONE}') as c_source,
        coalesce(lang, '{mixing.NONE}') as c_lang,
        case {topic} else '{mixing.OTHER_TOPIC}' end as c_topic,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as n from documents)""",
             """cells as (select c_source, c_lang, c_topic, sum(n)::double as tokens from docs
        group by all)"""]
    for d in dims:
        parts.append(f"""target_{d} as (select c_{d}, raw / sum(raw) over () as t_{d} from (
            select c_{d}, pow(sum(tokens), {mixture.targets[d]}) as raw from cells
            group by c_{d}) t)""")
    parts.append("""w0 as (select *, tokens / sum(tokens) over () as weight from cells
        join target_source using (c_source) join target_lang using (c_lang)
        join target_topic using (c_topic))""")
    step = 0
    for _ in range(mixture.rounds):
        for d in dims:
            parts.append(f"""w{step + 1} as (select * exclude (weight),
                weight * t_{d} / sum(weight) over (partition by c_{d}) as weight from w{step})""")
            step += 1
    parts.append(f"""levels as (select *, ({mixture.budget} * sum(tokens) over () - coalesce(sum(tokens)
        over before, 0)) / greatest(weight, sum(weight) over () - coalesce(sum(weight) over before, 0))
        as level from w{step} where weight > 0 window before as (order by tokens / weight, c_source,
        c_lang, c_topic rows between unbounded preceding and 1 preceding))""")
    parts.append("""rates as (select c_source, c_lang, c_topic,
        least(1.0, max(level) over () * weight / tokens) as p from levels)""")
    return "with " + ", ".join(parts) + f"""
        select doc_id, source, lang, c_topic as topic, n as n_tokens, round(coalesce(p, 1.0), 9) as p,
            cast('0x' || substr(md5('{mixture.seed}:' || doc_id), 1, 13) as bigint)
                / {float(1 << 52)} < coalesce(p, 1.0) as sampled
        from docs left join rates using (c_source, c_lang, c_topic)"""


SQL["op1_mix_sources"] = _mixing_sql(MIXTURE)


@query
def op6_embedding_join(spark: SparkSession, d: str) -> DataFrame:
    return embedding_join.near_vectors(spark.read.parquet(f"{d}/embeddings.parquet"))


@query
def op5_pack_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokenizer = packing.LibraryTokenizer(spark, public_tokenizers.path(TOKENIZER),
                                         public_tokenizers.PATTERN)
    return packing.described(packing.pack(documents(spark, d), tokenizer))


@query
def op13_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.divergence(documents(spark, d))


_P = "1 + ({scale}::hugeint * ({count} + 2)) // ({total} + 2 * kept)"
_GAP = "(p::hugeint - q) * (p - q) // (p::hugeint + q)"


def _divergence_sql(min_docs: int, top: int, scale: int) -> str:
    """Every group with every kept term, as the definition has it."""
    def share(count: str, total: str) -> str:
        return _P.format(scale=scale, count=count, total=total)

    return f"""with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words,
            row_number() over () as row_no from documents),
        found as (select row_no, lang, source, unnest(words) as word from docs),
        words as (select row_no, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') as term from found),
        kept_terms as (select lang, term, count(*) as lang_n from words group by all
            having count(distinct row_no) >= {min_docs}),
        counts as (select lang, source, term, count(*) as n from words group by all),
        groups as (select distinct lang, source from docs),
        langs as (select lang, count(*) as kept, sum(lang_n) as lang_total from kept_terms group by lang),
        full_counts as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.lang_n,
            l.kept, l.lang_total, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total
            from groups g join kept_terms k using (lang) join langs l using (lang)
            left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        shares as (select lang, source, term, n, {share('n', 'total')} as p,
            {share('lang_n', 'lang_total')} as lang_p from full_counts),
        gaps as (select a.lang, a.source, b.source as item, a.p, b.p as q from shares a
            join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source),
        summed as (select lang, source, item, sum({_GAP}) as value from gaps group by all),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item,
            coalesce(s.value, 0)::bigint as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
        set_off as (select lang, source, 'term' as part, term as item, ({_GAP})::bigint as value
            from (select lang, source, term, n, p, lang_p as q from shares) t where n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part
            order by value desc, item)::int as rank
            from (select * from pairs union all select * from set_off) t)
        select * from ranked where part = 'pair' or rank <= {top}"""


SQL["op13_source_divergence"] = _divergence_sql(divergence.MIN_DOCS, divergence.TOP_TERMS,
                                                divergence.SCALE)


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


@query
def op12_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.vector_codes(embeddings(spark, d))


def _vector_codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Complete scans in every round."""
    steps = [f"""vectors as (select vec_id, label, list_transform(embedding,
            lambda x: floor({scale}::double * x)::bigint) as v from embeddings
            where embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"""cut as (select vec_id, label, part, list_slice(v, part * (len(v) // {parts}) + 1,
            (part + 1) * (len(v) // {parts})) as x
            from vectors, (select unnest(range({parts})) as part) t)""",
             f"""seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry
            from vectors order by vec_id limit {entries})""",
             "book0 as (select part, entry, x as c from cut join seeds using (vec_id))"]
    for n in range(rounds + 1):
        steps.append(f"""near{n} as (select vec_id, label, part, any_value(x) as x, min(struct_pack(
            d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
            e := entry)) as best from cut join book{n} using (part) group by vec_id, label, part)""")
        if n < rounds:
            steps.append(f"""means{n} as (select part, best.e as entry, pos,
                (sum(value) - ((sum(value) % count(*)) + count(*)) % count(*)) // count(*) as c
                from (select part, best, unnest(x) as value, unnest(range(len(x))) as pos from near{n}) t
                group by part, best.e, pos)""")
            steps.append(f"""lists{n} as (select part, entry, list(c::bigint order by pos) as c
                from means{n} group by part, entry)""")
            steps.append(f"""book{n + 1} as (select b.part, b.entry, coalesce(l.c, b.c) as c
                from book{n} b left join lists{n} l on b.part = l.part and b.entry = l.entry)""")
    steps.append(f"""coded as (select vec_id, label, string_agg(printf('%02x', best.e::int), ''
        order by part) as code, sum(best.d)::bigint as error from near{rounds} group by vec_id, label)""")
    steps.append(f"""digest as (select sha256(string_agg(array_to_string(c, ','), ','
        order by part, entry)) as codebooks_sha256 from book{rounds})""")
    return "with " + ", ".join(steps).replace(" as (", " as materialized (") + """
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
            codebooks_sha256 from coded, digest"""


SQL["op12_vector_codes"] = _vector_codes_sql(vector_codes.PARTS, vector_codes.ENTRIES,
                                             vector_codes.ROUNDS, vector_codes.SCALE)


@query
def op11_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(embeddings(spark, d))

"""Queries over the operators of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm import covertree, jaccard, licenses, lsh, mixing, packing, pii, quality, spans, toxicity
from pointmill.llm.common import crc_of_id, staged, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_of_id("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes come from whole texts, counted once; the texts themselves need not travel
    sized = staged(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")))
    m = mixing.systematic_mix(sized, size="n")
    return m.select(F.col("r.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_of_id("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return out.select(F.col("r.doc_id").alias("doc_id"), F.col("new_text").alias("text"), "n_replaced")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_licenses, op3_mixing, op4_toxicity, op5_repeated_spans, op6_embedding_links, op7_packing, op8_jaccard, op9_surrogates, op10_top_k)}


_WORDS = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as w from d group by source
), o as (
  select *, 3.0 * source_size as full_, sum(source_size) over () as total,
    coalesce(sum(3.0 * source_size) over p, 0) as full_before, coalesce(sum(w) over p, 0) as w_before, sum(w) over () as w_all
  from s window p as (order by 3.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)
), r as (
  select *, (total - full_before) / (w_all - w_before) as rate from o
), t as (
  select source, source_size, least(full_, w * (select rate from r where rate * w <= full_ order by full_ / w, source nulls last limit 1)) as target from r
), k as (
  select d.*, t.source_size, t.target, coalesce('s' || d.source, 'n') as src,
    row_number() over (partition by d.source order by floor(log2(d.size + 1.0) * 4), coalesce(('0x' || substr(md5(d.doc_id::varchar), 1, 4))::int % 1024, 0), d.size, d.doc_id) as k
  from d join t on d.source is not distinct from t.source
), c as (
  select *, case when source_size > 0 then target / source_size else 0 end as rate, ('0x' || substr(md5('mix:' || src), 1, 4))::int / 65536.0::double as offset_ from k
)
select doc_id, size, source_size, target, (floor(k * rate + offset_) - floor((k - 1) * rate + offset_))::int as copies, size * copies as taken from c
"""

_OP5 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i+49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
first_ as (select h, min(doc_id) as first_doc from win group by h having count(*) > 1),
lost as (select distinct doc_id, i + j as pos from (select doc_id, i, unnest(range(50)) as j from win join first_ using (h) where first_doc < doc_id)),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as pos from d),
kept as (select doc_id, string_agg(x, ' ' order by pos) as kept, count(*) as n from word anti join lost using (doc_id, pos) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)
"""

_COMPONENTS = """
reach(id, lo) as (
  select id, id from nodes union
  select e.b, r.lo from reach r join both_ e on e.a = r.id where r.lo < e.b
), comp as (select id, min(lo) as component_id from reach group by id)
"""

_OP6 = f"""
with recursive v as (
  select vec_id, embedding::double[] as x from embeddings where embedding is not null
), ok as (select vec_id, x from v where len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and list_dot_product(x, x) > 0
), link as (
  select p.vec_id as a, q.vec_id as b from ok p join ok q on p.vec_id < q.vec_id
  where list_dot_product(p.x, q.x) / sqrt(list_dot_product(p.x, p.x) * list_dot_product(q.x, q.x)) >= 0.9
), both_ as (select a, b from link union all select b, a from link), nodes as (select vec_id as id from embeddings), {_COMPONENTS}
select e.vec_id, (select count(*) from both_ where a = e.vec_id)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join comp on id = e.vec_id
"""

_OP8 = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as w from documents
), s as (
  select distinct doc_id, md5(array_to_string(w[i:i+4], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select p.doc_id as a, q.doc_id as b, count(*) as k from s p join s q on p.g = q.g and p.doc_id < q.doc_id group by all),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
both_ as (select a, b from link union all select b, a from link), nodes as (select doc_id as id from documents), {_COMPONENTS}
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id from d left join n using (doc_id) join comp on id = d.doc_id
"""

_OP10 = """
with v as (select vec_id, embedding::double[] as x from embeddings where embedding is not null),
ok as (select vec_id, list_transform(x, lambda c: floor(256 * c)) as x from v where len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.x, c.x)::bigint as score from ok q join ok c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _OP3, "op5_repeated_spans": _OP5, "op6_embedding_links": _OP6, "op8_jaccard": _OP8, "op10_top_k": _OP10}

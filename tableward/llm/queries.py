"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableward.llm import (
    bpe, centroids, chat, collocations, embedding_neighbors, fingerprints, language, packing, quality_rules, sharding, simhash,
    subwords, toxicity,
)
from tableward.llm.common import is_held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


@query("op10_bpe_prefix")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    made = bpe.encode_decode(documents(spark, folder), "text", ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))
    return made.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op8_hierarchical_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in windows of at most 1024 tokens."""
    pieces = packing.pack(documents(spark, folder), "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step_group")


@query("op6_kd_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    placed = sharding.kd_shards(documents(spark, folder), "doc_id", "text", ["lang", "source"], shards=16)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


@query("op9_adaptive_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Base measures and verdict of every document."""
    judged = quality_rules.judge(documents(spark, folder), "text", "lang", "source", ["doc_id"])
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "level")


@query("op7_subword_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    docs = documents(spark, folder)
    model = subwords.train(docs, labels(spark, folder), "doc_id", "text", "quality", 5, 0)
    return subwords.score(docs, "text", ["doc_id"], model).select(
        "doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_noisy_channel_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    docs = documents(spark, folder)
    model = toxicity.char_model(docs, "text")
    rates, base = toxicity.train(docs, labels(spark, folder), "doc_id", "text", "toxic", 3, 1, model)
    return toxicity.score(docs, "text", ["doc_id"], model, rates, base).select(
        "doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_simhash_trie")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.groups(documents(spark, folder), "doc_id", "text", width=3, budget=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_projection_forest")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Links and groups of every embedding."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return embedding_neighbors.neighbors(vectors, "vec_id", "embedding", "label", 0.98).select(
        "vec_id", "n_links", "component_id", "kept")


CHAT_SQL = """
with turns as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place from turns
), speakers as (
  select distinct conv_id, role as perspective from turns where role <> 'system'
), messages as (
  select p.conv_id, s.perspective, cast(p.place // 64 as bigint) as part, p.place, p.role = s.perspective as trained,
    '<|im_start|>' || case when p.role = s.perspective then 'assistant' when p.role = 'system' then 'system'
      else 'user name=' || p.role end || chr(10) as head, p.text as body
  from placed p join speakers s on p.conv_id is not distinct from s.conv_id
), offsets as (
  select *, sum(length(head) + length(body) + 11) over w - (length(head) + length(body) + 11) + length(head) as start
  from messages window w as (partition by conv_id, perspective, part order by place)
)
select conv_id, perspective, part, count(*) as n_turns, cast(sum(trained::int) as bigint) as n_trained,
  string_agg(head || body || '<|im_end|>' || chr(10), '' order by place) as rendered,
  coalesce(string_agg(case when trained then start || ':' || (length(body) + 10) end, ',' order by place), '') as spans
from offsets group by conv_id, perspective, part
"""


@query("op1_perspective_rotation", CHAT_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from the perspective of each of its speakers."""
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    made = chat.rotate(turns, "conv_id", "turn", "role", "text")
    return made.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat(
        s["start"].cast("string"), F.lit(":"), s["length"].cast("string"))), ","))


@query("op5_language_fusion")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return language.identify(pages, documents(spark, folder), "page_id", "url", "html", "text", "lang")


@query("op11_closed_syncmers")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are."""
    made = fingerprints.edited_likeness(documents(spark, folder), "doc_id", "text")
    return made.withColumns({c: fingerprints.printed(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


CLUSTERS, ROUNDS = 40, 5


def _centroid_sql() -> str:
    """Every round spelt out: assign, then move the centroids that have vectors."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} as (
  select id, min(struct_pack(d := d, c := c)) as best from (
    select v.id, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from v, c{r} c) group by id)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} as (
  select c, list(m order by i) as x from (
    select c, i, ((s - ((s % n) + n) % n) // n)::bigint as m from (
      select c, i, sum(x) as s, count(*) as n from (
        select best.c as c, unnest(range(64)) as i, unnest(x) as x from a{r} join v using (id)) group by all)) group by c),
c{r + 1} as (select c.c, coalesce(s{r}.x, c.x) as x from c{r} c left join s{r} on s{r}.c = c.c)""")
    return f"""
with v as (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
c0 as (
  select row_number() over (order by sha256('2:' || vec_id), x) - 1 as c, x from v
  order by sha256('2:' || vec_id), x limit {CLUSTERS}),{",".join(steps)},
t as (select best.c as c, sum(best.d)::bigint as s from a{ROUNDS} group by 1)
select v.vec_id, a.best.c::int as cluster, a.best.d as distance, t.s as cluster_inertia,
  (select sum(s) from t)::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from v join a{ROUNDS} a using (id) join t on t.c = a.best.c join c{ROUNDS} c on c.c = a.best.c"""


@query("op12_expiring_bounds", _centroid_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster and distance of every embedding."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return centroids.fit(vectors, "vec_id", "embedding", CLUSTERS, ROUNDS).rows


COLLOCATION_SQL = r"""
with recursive pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)
), starts as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from pieces
), f as (
  select lang, k as words, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from starts, (values (1), (2), (3), (4)) sizes(k) where i + k - 1 <= len(w) group by all
), found as (
  select *, string_split(phrase, ' ') as w from f where f >= 30
), split as (
  select lang, phrase, words, f as a, k, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from (select *, unnest(range(1, words)) as k from found where words > 1)
), cuts as (
  select s.lang, s.phrase, s.words, a, k, l.f as l, r.f as r, (2000000::hugeint * a) // (l.f + r.f) as score
  from split s join found l on l.lang = s.lang and l.phrase = s.first join found r on r.lang = s.lang and r.phrase = s.rest
), weakest as (
  select lang, phrase, words, a, min(struct_pack(score := score, k := k, l := l, r := r)) as cut from cuts group by all
), longer as (
  select lang, phrase, max(f) as most from (
    select lang, f, array_to_string(w[:-2], ' ') as phrase from found where words >= 3
    union all select lang, f, array_to_string(w[2:], ' ') from found where words >= 3
    union all select lang, f, array_to_string(w[:-3], ' ') from found where words = 4
    union all select lang, f, array_to_string(w[3:], ' ') from found where words = 4
    union all select lang, f, array_to_string(w[2:3], ' ') from found where words = 4) group by all
), edges as (
  select e.lang, e.phrase, array_to_string(e.w[:-2], ' ') as tail, array_to_string(e.w[2:], ' ') as head, e.f from found e where e.words = 4
), linked as (
  select a.lang, a.phrase as a, b.phrase as b from edges a join edges b on a.lang = b.lang and a.head = b.tail and a.f = b.f
  join found node on node.lang = a.lang and node.phrase = a.head and node.f = a.f
), walk as (
  select lang, phrase as start, phrase, 4 as words from edges e
  where not exists (select 1 from linked k where k.lang = e.lang and k.b = e.phrase)
  union all select walk.lang, start, k.b, walk.words + 1 from walk join linked k on k.lang = walk.lang and k.a = walk.phrase
), path as (
  select lang, phrase, max(words) over (partition by lang, start) as path_words from walk
), ranked as (
  select w.lang, row_number() over (partition by w.lang order by cut.score desc, a desc, w.phrase) as rank, w.phrase, words, a, cut
  from weakest w left join longer using (lang, phrase) where most is null or 100 * most < 80 * a
)
select lang, rank, phrase, a, cut.l as l, cut.r as r, (select sum(f)::bigint from f where f.lang = ranked.lang and words = 1) as n,
  cut.score::bigint as score, coalesce(path_words, words)::bigint as path_words
from ranked left join path using (lang, phrase) where rank <= 2000
"""


@query("op13_de_bruijn_phrases", COLLOCATION_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations.collocations(documents(spark, folder), "text", "lang")

"""The queries of this subpackage's operators, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navella.llm import edit_counts, id_files, jaccard_join, media, merkle, nearest, packing, prefix_trie, quality, secret_scan, toxicity, url_filter, word_trie
from navella.llm.tokens import text_column, vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts tokens of every document, then follows three edits of each: a run of 12 characters at a place given
    by its text becomes a mark, its first five characters go, and a line is put at its end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_column(table(spark, sf_dir, "documents")).alias("text"))
    path = vocabulary("byte_bpe_50k.json")
    n = F.char_length("text")
    place = (F.crc32(F.encode("text", "UTF-8")) % (n + 1)).cast("int")
    edits = F.array(edit_counts.edit(place, place + 12, F.lit(" [removed]")), edit_counts.edit(F.lit(0), F.lit(5), F.lit("")), edit_counts.edit(n + 20, n + 20, F.lit("\nEdited by 2 readers.")))
    return edit_counts.edited_counts(docs.withColumn("edits", edits), path)


def remainder(by: int):
    """crc32 of doc_id as text, modulo by; null ids have none."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % by


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document."""
    return jaccard_join.component_ids(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes the ids and tells whether the text came back."""
    return word_trie.round_trips(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as an image, reads the archives back and describes the images."""
    path = media.store_texts(table(spark, sf_dir, "documents"))
    return media.describe(media.read_media(spark, path))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on labelled documents of which the remainder by 3 isn't 1."""
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3) != 1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the quality of every document."""
    docs = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return docs.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0, 2048)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled documents of which the remainder by 5 isn't 0."""
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) != 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores the toxicity of every document."""
    docs = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return docs.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids to id files and reads them back."""
    return id_files.read_id_files(id_files.write_id_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds secrets in every whole text."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base, counts = F.col("base"), [secret_scan.count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, verified against its row, to which some rows have had 1 added to n_chars."""
    tampered = merkle.document_leaf(F.when(remainder(7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)")))
    found = merkle.proofs(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_url_filter,
        op3_jaccard_join,
        op4_sentencepiece,
        op5_media,
        op6_quality,
        op7_packing,
        op8_nearest,
        op9_toxicity,
        op10_id_files,
        op11_secrets,
        op12_merkle,
        op13_prefix_trie,
    )
}

#: crc32 of a column's decimal text in SQL, for DuckDB, which has none: each byte in, then its eight bits out.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}::varchar) + 1), lambda i: ascii(substr({0}::varchar, i, 1))::bigint)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295)"


def _crc(column: str) -> str:
    return _CRC.replace("{0}", column)


_FIELD = "case when {0} is null then '-' else strlen({0}::varchar)::varchar || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.replace("{0}", c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
MERKLE_SQL = f"""with recursive d as (select doc_id, lang, {_LEAF.replace("{n}", "n_chars")} leaf, case when {_crc("doc_id")} % 7 = 0 then {_LEAF.replace("{n}", "(n_chars + 1)")} else {_LEAF.replace("{n}", "n_chars")} end claimed from documents),
f as (select lang, list(leaf order by doc_id nulls first, leaf) nodes, 0 lv from d group by lang union all select lang, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))), lv + 1 from f where len(nodes) > 1),
s as (select lang, nodes[1] subroot, row_number() over (order by lang is not null, encode(lang)) - 1 p from f where len(nodes) = 1),
o as (select list(subroot order by p) nodes, 0 lv from s union all select list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))), lv + 1 from o where len(nodes) > 1),
w as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 p from d),
c as (select doc_id, lang, leaf, claimed x, p, 0 lv, '' proof from w
  union all select c.doc_id, c.lang, c.leaf, case when c.p & 1 = 1 then sha256(f.nodes[c.p] || c.x) else sha256(c.x || coalesce(f.nodes[c.p + 2], '')) end, c.p >> 1, c.lv + 1, c.proof || case when c.p & 1 = 1 then f.nodes[c.p] else coalesce(f.nodes[c.p + 2], '') end
  from c join f on f.lang is not distinct from c.lang and f.lv = c.lv where len(f.nodes) > 1),
m as (select c.* from c join f on f.lang is not distinct from c.lang and f.lv = c.lv where len(f.nodes) = 1),
u as (select m.doc_id, m.leaf, s.subroot, m.x, s.p, 0 lv, m.proof from m join s on s.lang is not distinct from m.lang
  union all select u.doc_id, u.leaf, u.subroot, case when u.p & 1 = 1 then sha256(o.nodes[u.p] || u.x) else sha256(u.x || coalesce(o.nodes[u.p + 2], '')) end, u.p >> 1, u.lv + 1, u.proof || case when u.p & 1 = 1 then o.nodes[u.p] else coalesce(o.nodes[u.p + 2], '') end
  from u join o on o.lv = u.lv where len(o.nodes) > 1)
select doc_id, leaf, subroot, nodes[1] root, sha256(proof) proof_sha256, x folded_root, x = nodes[1] verified from u join o on o.lv = u.lv where len(o.nodes) = 1"""

TRIE_SQL = f"""with t as (select conv_id, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w, turn from conversations where conv_id is not null),
l as (select conv_id, list({{'id': id, 'w': w}} order by turn nulls first, id) ts, {_crc("conv_id")} % 4 h from t group by conv_id),
r as (select l.conv_id, list_concat(coalesce(b.ts, [])[1:l.h], l.ts[l.h + 1:]) ts from l left join l b on b.conv_id = l.conv_id - l.conv_id % 20),
p as (select conv_id, len(ts) size, ts, unnest(range(0, len(ts) + 1)) depth from r),
n as (select depth, list_transform(ts[1:depth], lambda x: x.id) ids, min(conv_id) conv_id, count(*) n_convs, any_value(case when depth > 0 then ts[depth].w else 0 end) w, string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth) ends from p group by 1, 2),
k as (select depth - 1 depth, ids[1:depth - 1] ids, count(*) c from n where depth > 0 group by 1, 2),
a as (select n.*, coalesce(c, 0) n_children from n left join k using (depth, ids)),
s as (select depth - up depth, ids[1:depth - up] ids, sum((n_children = 0)::int) leaves, sum((n_convs - 1) * w) saved from (select *, unnest(range(0, depth + 1)) up from a) group by 1, 2)
select a.conv_id, a.depth, q.conv_id parent_conv_id, a.n_convs, a.n_children, s.leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(coalesce(a.ends, '')) ends_sha256
from a join s using (depth, ids) left join n q on q.depth = a.depth - 1 and q.ids = a.ids[1:a.depth - 1]"""

#: The other operators are tested against plain versions, exact round trips or held-out rows.
ORACLES: dict[str, str] = {"op12_merkle": MERKLE_SQL, "op13_prefix_trie": TRIE_SQL}

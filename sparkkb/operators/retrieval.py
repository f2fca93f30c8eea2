"""Full-text, vector and hybrid retrieval of chunks and files."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkb.functions.text import TOKEN_SQL, tokens
from sparkkb.operators import links, search
from sparkkb.plans import filters
from sparkkb.session import materialize, table

#: Over-fetch of the text and the vector side of a chunk search, and of both in a file search; weights of the sides, and the bonus for both.
TEXT_FACTOR, VECTOR_FACTOR, FILE_FACTOR = 3, 4, 50
TEXT_WEIGHT, VECTOR_WEIGHT, BOTH_BONUS = 0.4, 0.6, 0.05
#: Weight of a term in the cover density.
TERM_WEIGHT = 0.1
BLOCK_ROWS = 4096
_TERM = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
#: Columns of a hit that its pool carries along.
CARRIED = ("kb_code", "knowledge_base_id", "fs_entry_id", "full_path", "chunk_no", "start_line", "end_line", "chunk_text")


def live_chunks(chunks: DataFrame, entries: DataFrame, bases: DataFrame) -> DataFrame:
    """Chunks of live files in live bases, with base code and path: the retrieval projection as a view."""
    live = bases.where("is_deleted = false").select(F.col("kid").alias("knowledge_base_id"))
    files = entries.where("entry_type = 'FILE' and is_deleted = false").join(live, "knowledge_base_id", "left_semi")
    files = files.select(F.col("kid").alias("fs_entry_id"), F.ltrim(F.col("virtual_path"), F.lit("/")).alias("full_path"))
    return chunks.join(files, "fs_entry_id").select(
        F.col("kid").alias("chunk_id"), "knowledge_base_id", F.col("knowledge_base_id").cast("string").alias("kb_code"), "fs_entry_id", "full_path", "chunk_no", "start_line", "end_line", "chunk_text")


def _cover_density(places: list[np.ndarray]) -> float:
    """Covers are the shortest spans that hold all terms; each adds TERM_WEIGHT, divided by one more than the words in it that are no terms."""
    at = np.concatenate(places)
    term = np.repeat(np.arange(len(places)), [len(p) for p in places])
    order = np.argsort(at, kind="stable")
    at, term = at[order], term[order]
    last = np.full(len(places), -1)
    covers: list[tuple[int, int]] = []
    for p, t in zip(at.tolist(), term.tolist(), strict=True):
        last[t] = p
        if last.min() >= 0:
            begin = int(last.min())
            if not covers or covers[-1][0] != begin:
                covers.append((begin, p))
    return float(sum(TERM_WEIGHT / (1 + end - begin - (len(places) - 1)) for begin, end in covers))


def text_recall(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold every term of a query, with text_score. A query without terms finds nothing.

    For one term the score is its weight times its occurrences; for more, the cover density of the terms.
    """
    terms = list(dict.fromkeys(_TERM.findall(query.lower())))
    if not terms:
        return chunks.where(F.lit(False)).withColumn("text_score", F.lit(0.0))
    low = F.lower("chunk_text")
    for term in terms:  # cheap, and leaves few texts to cut into tokens
        chunks = chunks.where(low.contains(term))
    found = chunks.withColumn("__tokens", tokens("chunk_text")).where(F.size(F.array_except(F.array(*map(F.lit, terms)), "__tokens")) == 0)
    if len(terms) == 1:
        return found.withColumn("text_score", F.size(F.filter("__tokens", lambda x: x == terms[0])) * TERM_WEIGHT).drop("__tokens")

    @F.pandas_udf("double")
    def density(rows: pd.Series) -> pd.Series:
        return pd.Series([_cover_density([np.flatnonzero(words == t) for t in terms]) for words in (np.asarray(r, object) for r in rows)], dtype=float)

    return found.withColumn("text_score", density("__tokens")).drop("__tokens")


def cosine(vectors: Column, query: list[float]) -> Column:
    """Cosine of each vector with the query, in doubles, a batch at a time; null where either is zero or null, or of another dimension."""
    q = np.asarray(query, float)
    size = np.linalg.norm(q)

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(batch), len(q)), False).to_numpy(zero_copy_only=False)
        out = np.full(len(batch), np.nan)
        if len(q) and size and fits.any():
            m = pc.list_flatten(batch.filter(pa.array(fits))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[fits] = m @ q / (np.linalg.norm(m, axis=1) * size)
        return pa.array(out, mask=~np.isfinite(out))

    return score(vectors)


def vector_recall(chunks: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Chunks with a vector, with vector_score, the cosine to the query (exact). Zero vectors are left out."""
    scored = vectors.select(F.col("vec_id").alias("chunk_id"), cosine(F.col("embedding"), query).alias("vector_score")).where("vector_score is not null")
    return chunks.join(scored, "chunk_id")


def fuse(text: DataFrame | None, vector: DataFrame | None) -> DataFrame:
    """Hits of both sides by chunk: weights 0.4 and 0.6, a bonus for hits of both; a side alone, or one whose other side is empty, counts full. Other columns of a hit are carried along.

    The sides are pools, limited already, so that the whole result is small; each is evaluated once.
    """
    sides = [(text, "text_score", "vector_score"), (vector, "vector_score", "text_score")]
    some = [d.select("chunk_id", *[c for c in CARRIED if c in d.columns], F.col(own), F.lit(None).cast("double").alias(other)) for d, own, other in sides if d is not None]
    both = some[0] if len(some) == 1 else some[0].unionByName(some[1])
    rest = [c for c in both.columns if c not in ("chunk_id", "text_score", "vector_score")]
    both = both.groupBy("chunk_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest], F.max("text_score").alias("t"), F.max("vector_score").alias("v"))
    pool = Window.partitionBy()
    alone = (F.count("t").over(pool) == 0) | (F.count("v").over(pool) == 0)
    t, v = F.coalesce("t", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    score = F.when(alone, t + v).otherwise(t * TEXT_WEIGHT + v * VECTOR_WEIGHT) + F.when((t != 0) & (v != 0), BOTH_BONUS).otherwise(0.0)
    return both.select("chunk_id", *rest, t.alias("text_score"), v.alias("vector_score"), score.alias("score"))


def _pools(chunks, vectors, text, vector, mode, text_k, vector_k):
    t = text_recall(chunks, text).orderBy(F.desc("text_score"), F.desc("chunk_id")).limit(text_k) if mode != "embedding" else None
    v = vector_recall(chunks, vectors, vector).orderBy(F.desc("vector_score"), F.desc("chunk_id")).limit(vector_k) if mode != "fullTextRecall" else None
    return fuse(t, v)


def best_chunks(chunks: DataFrame, vectors: DataFrame, text: str, vector: list[float], k: int = 10, mode: str = "mixedRecall", files: DataFrame | None = None, bases: list[str] | None = None) -> DataFrame:
    """The k best chunks by fused score, then chunk_id, with all their columns. mode: fullTextRecall, embedding or mixedRecall; files restricts to their kid, bases to codes of bases."""
    if bases is not None:
        chunks = chunks.where(F.col("kb_code").isin(bases))
    if files is not None:
        chunks = chunks.join(files.select(F.col("kid").alias("fs_entry_id")), "fs_entry_id", "left_semi")
    return _pools(chunks, vectors, text, vector, mode, TEXT_FACTOR * k, VECTOR_FACTOR * k).orderBy(F.desc("score"), F.desc("chunk_id")).limit(k)


def search_chunks(chunks: DataFrame, vectors: DataFrame, text: str, vector: list[float], k: int = 10, mode: str = "mixedRecall", files: DataFrame | None = None, bases: list[str] | None = None) -> DataFrame:
    """best_chunks() as (chunk_id, kb_code, file_path, chunk_no, score)."""
    best = best_chunks(chunks, vectors, text, vector, k, mode, files, bases)
    return best.select("chunk_id", "kb_code", F.concat(F.lit("/"), F.col("full_path")).alias("file_path"), "chunk_no", F.round("score", 6).alias("score"))


def completed(best: DataFrame, values: DataFrame, links_: DataFrame, entries: DataFrame, names: list[str]) -> DataFrame:
    """Hits with what a reader gets: path, lines, text with its reference tokens resolved, score, and the named attributes of the file as a map."""
    best = materialize(best, "hits")  # k rows, read three times
    own = search.backfill(best.select(F.col("fs_entry_id").alias("kid")).distinct(), values, names).groupBy(F.col("kid").alias("fs_entry_id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_name", "value")))).alias("metadata"))
    said = links.resolve_tokens(best.where(F.col("chunk_text").contains(links.SCHEME)), "chunk_id", "knowledge_base_id", "chunk_text", links_, entries).withColumnRenamed("text", "__said")
    full = best.join(said, "chunk_id", "left").join(own, "fs_entry_id", "left")
    return full.select("chunk_id", "kb_code", F.concat(F.lit("/"), F.col("full_path")).alias("file_path"), "chunk_no", "start_line", "end_line", F.coalesce("__said", "chunk_text").alias("chunk_text"), F.round("score", 6).alias("score"), "metadata")


def search_files(chunks: DataFrame, vectors: DataFrame, text: str, vector: list[float], k: int = 10) -> DataFrame:
    """The k best files by the best fused score of their chunks; ties by the greatest chunk."""
    pool = _pools(chunks, vectors, text, vector, "mixedRecall", FILE_FACTOR * k, FILE_FACTOR * k)
    return pool.groupBy("kb_code", "full_path").agg(F.max("score").alias("best"), F.max("chunk_id").alias("last_chunk"), F.count(F.lit(1)).alias("hits")).orderBy(F.desc("best"), F.desc("last_chunk")).limit(k).select(
        "kb_code", "full_path", F.round("best", 6).alias("score"), "hits")


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(ids, values): unit vectors of up to rows rows as one flat list; null and zero vectors are left out, and those of another dimension than the first of their batch."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            n = pc.list_value_length(lists)
            width = next((x for x in n.to_pylist() if x), 0)
            fits = pc.fill_null(pc.equal(n, width), False)
            m = pc.list_flatten(lists.filter(fits)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, max(1, width))
            size = np.linalg.norm(m, axis=1)
            own, m = ids.filter(fits).to_numpy()[size > 0], m[size > 0] / size[size > 0, None]
            for i in range(0, len(own), rows):
                part = m[i : i + rows]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (own[i : i + rows], part.ravel())], ["ids", "values"])

    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "ids array<long>, values array<double>")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors with the greatest cosine to each query, exact, ties by the greater id.

    A block of queries meets a block of vectors in one matrix product; only k of each block go on to the final ranking.
    """
    left = _blocks(queries, BLOCK_ROWS // 4).select(F.col("ids").alias("q_ids"), F.col("values").alias("q"))
    right = _blocks(vectors, BLOCK_ROWS).select(F.col("ids").alias("v_ids"), F.col("values").alias("v"))

    def run(batches):
        for batch in batches:
            for qi, q, vi, v in zip(*(batch.column(c) for c in ("q_ids", "q", "v_ids", "v")), strict=True):
                qi, q, vi, v = (x.values.to_numpy() for x in (qi, q, vi, v))
                if len(q) // len(qi) != len(v) // len(vi):
                    continue
                s = np.round(q.reshape(len(qi), -1) @ v.reshape(len(vi), -1).T, 9)
                by_id = np.argsort(-vi, kind="stable")
                best = by_id[np.argsort(-s[:, by_id], axis=1, kind="stable")[:, :k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, best.shape[1])), pa.array(vi[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], ["query_id", "vec_id", "score"])

    hits = left.crossJoin(right).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def text_recall_batch(chunks: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, text_score, rank): the k best chunks of each query (query_id, text) that hold all its terms, scored as by text_recall().

    Queries of the same terms are one. They meet the chunks by their rarest term, and what they meet there is looked up for the others: no term
    that many queries share brings them together with all its chunks, unless it is the rarest. Queries of no terms, and those that nothing answers,
    have no rows. Repeated queries count once.
    """
    asked = queries.select("query_id", F.array_sort(F.array_distinct(tokens("text"))).alias("terms")).where(F.size("terms") > 0).distinct()
    sets = asked.select("terms", F.xxhash64("terms").alias("set")).distinct()
    wanted = sets.select(F.explode("terms").alias("term")).distinct()
    words = chunks.select("chunk_id", F.posexplode(tokens("chunk_text")).alias("place", "term")).join(wanted, "term", "left_semi")
    stored = materialize(words.groupBy("term", "chunk_id").agg(F.sort_array(F.collect_list("place")).alias("places")), "postings")
    held = stored.groupBy("term").agg(F.count(F.lit(1)).alias("chunks"))
    each = sets.select("set", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    rarest = each.join(held, "term", "left").groupBy("set", "n_terms").agg(F.min(F.struct(F.coalesce("chunks", F.lit(0)).alias("chunks"), "term")).alias("least")).where("least.chunks > 0")
    met = rarest.select("set", "n_terms", F.col("least.term").alias("term")).join(stored.select("term", "chunk_id"), "term").select("set", "n_terms", "chunk_id")
    found = met.join(each.select("set", "term"), "set").join(stored, ["term", "chunk_id"])
    whole = found.groupBy("set", "chunk_id", "n_terms").agg(F.collect_list("places").alias("places")).where(F.size("places") == F.col("n_terms"))

    @F.pandas_udf("double")
    def density(rows: pd.Series) -> pd.Series:
        return pd.Series([len(r[0]) * TERM_WEIGHT if len(r) == 1 else _cover_density([np.asarray(p) for p in r]) for r in rows], dtype=float)

    order = Window.partitionBy("set").orderBy(F.desc("text_score"), F.desc("chunk_id"))
    scored = whole.withColumn("text_score", F.round(density("places"), 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("query_id", F.xxhash64("terms").alias("set")).join(scored, "set").select("query_id", "chunk_id", "text_score", "rank")


def federated_merge(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits of several bases in one order: bases that are not allowed become one error row each, first; then scores, then ids."""
    codes = allowed.select("kb_code").distinct()
    refused = hits.select("kb_code").distinct().join(codes, "kb_code", "left_anti").select("kb_code", F.lit(None).cast("long").alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_error"))
    good = hits.join(codes, "kb_code", "left_semi").select("kb_code", "chunk_id", "score", F.lit(False).alias("is_error"))
    return refused.unionByName(good).orderBy(F.desc("is_error"), F.desc_nulls_last("score"), F.desc_nulls_last("chunk_id"), "kb_code")


def fan_out(codes: DataFrame, bases: DataFrame) -> DataFrame:
    """(service, kb_codes) of asked codes: those that one service (kb_name) answers together, once each; service null has the codes that none answers."""
    live = bases.where("is_deleted = false").select(F.col("kid").cast("string").alias("kb_code"), F.col("kb_name").alias("service"))
    return codes.select("kb_code").distinct().join(live, "kb_code", "left").groupBy("service").agg(F.array_sort(F.collect_set("kb_code")).alias("kb_codes"))


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Each chunk once, with its best score."""
    return hits.groupBy("chunk_id").agg(F.max("score").alias("score"))


def path_type(path: Column | str) -> Column:
    """What follows the last dot of a whole path, in lower case; null without a dot."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.contains("."), F.lower(F.regexp_extract(path, r"[^.]+$", 0)))


TERM, PAIR, TERMS = "checkpoint", "audit trail", "stale audit trail"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_chunks(table(spark, sf_dir, "knowledge_chunk"), table(spark, sf_dir, "knowledge_fs_entry"), table(spark, sf_dir, "knowledge_base"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _first(spark, sf_dir):
    return _vectors(spark, sf_dir).where("vec_id = 0").first()["embedding"]


def hybrid_search_topk(spark, sf_dir):
    return search_chunks(_live(spark, sf_dir), _vectors(spark, sf_dir), TERM, _first(spark, sf_dir))


def text_recall_topk(spark, sf_dir):
    return search_chunks(_live(spark, sf_dir), _vectors(spark, sf_dir), TERM, [], mode="fullTextRecall")


def text_recall_all(spark, sf_dir):
    return text_recall(_live(spark, sf_dir), TERM).select("chunk_id", F.round("text_score", 6).alias("text_score"))


def text_recall_two_terms(spark, sf_dir):
    return text_recall(_live(spark, sf_dir), PAIR).select("chunk_id", F.round("text_score", 6).alias("text_score"))


def hybrid_dual_hit_bonus(spark, sf_dir):
    """Chunks that both sides find, all of them pooled."""
    live = _live(spark, sf_dir)
    fused = fuse(text_recall(live, TERM), vector_recall(live, _vectors(spark, sf_dir), _first(spark, sf_dir)))
    return fused.where("text_score != 0 and vector_score != 0").select("chunk_id", F.round("text_score", 6).alias("text_score"), F.round("vector_score", 6).alias("vector_score"), F.round("score", 6).alias("score"))


def text_recall_cover_density(spark, sf_dir):
    return text_recall(_live(spark, sf_dir), TERMS).select("chunk_id", F.round("text_score", 6).alias("text_score"))


def vector_recall_topk(spark, sf_dir):
    return search_chunks(_live(spark, sf_dir), _vectors(spark, sf_dir), "", _first(spark, sf_dir), mode="embedding")


def hybrid_one_side_empty(spark, sf_dir):
    return search_chunks(_live(spark, sf_dir), _vectors(spark, sf_dir), "nosuchword", _first(spark, sf_dir))


def hybrid_with_filter(spark, sf_dir):
    files = filters.apply(table(spark, sf_dir, "knowledge_fs_entry"), table(spark, sf_dir, "knowledge_file_metadata_value"), {"in": {"fieldName": "fileType", "value": ["md", "txt"]}})
    return search_chunks(_live(spark, sf_dir), _vectors(spark, sf_dir), TERM, _first(spark, sf_dir), files=files)


def search_file_max_score(spark, sf_dir):
    return search_files(_live(spark, sf_dir), _vectors(spark, sf_dir), TERM, _first(spark, sf_dir))


def vector_nearest_batch(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)


def _merged(spark, sf_dir):
    hits = text_recall(_live(spark, sf_dir), TERM).select("kb_code", "chunk_id", F.col("text_score").alias("score"))
    return federated_merge(hits, table(spark, sf_dir, "knowledge_base").where("is_deleted = false and kb_description is not null").select(F.col("kid").cast("string").alias("kb_code")))


def federated_merge_hits(spark, sf_dir):
    return _merged(spark, sf_dir).select("kb_code", "chunk_id", F.round("score", 6).alias("score"), "is_error")


def federated_order(spark, sf_dir):
    """The first 40 rows of the merged order."""
    first = _merged(spark, sf_dir).limit(40)
    return first.select("kb_code", "chunk_id", F.round("score", 6).alias("score"), "is_error")


def hybrid_in_bases(spark, sf_dir):
    return search_chunks(_live(spark, sf_dir), _vectors(spark, sf_dir), TERM, _first(spark, sf_dir), bases=["3", "7", "11"])


def hybrid_search_complete(spark, sf_dir):
    """The best chunks with lines, text and attributes; each text has tokens of two edges before it."""
    chunks = _live(spark, sf_dir)
    chunks = chunks.withColumn("chunk_text", F.concat(F.lit(links.SCHEME), F.col("chunk_id") % 500, F.lit(" "), "chunk_text"))
    best = best_chunks(chunks, _vectors(spark, sf_dir), TERM, _first(spark, sf_dir), k=200)
    full = completed(best, table(spark, sf_dir, "knowledge_file_metadata_value"), table(spark, sf_dir, "knowledge_file_reference"), table(spark, sf_dir, "knowledge_fs_entry"), ["review_state", "revision"])
    return full.withColumns({"review_state": F.col("metadata")["review_state"], "revision": F.col("metadata")["revision"]}).drop("metadata")


def file_type_filter(spark, sf_dir):
    """Live chunks of files whose path has one of two types, by base."""
    return _live(spark, sf_dir).where(path_type("full_path").isin("md", "txt")).groupBy("kb_code").agg(F.count(F.lit(1)).alias("n"))


def distinct_chunk_hits(spark, sf_dir):
    """Hits of two words, each chunk once."""
    live = _live(spark, sf_dir)
    both = text_recall(live, TERM).unionByName(text_recall(live, "index")).select("chunk_id", F.col("text_score").alias("score"))
    return distinct_hits(both).select("chunk_id", F.round("score", 6).alias("score"))


def service_fan_out(spark, sf_dir):
    codes = table(spark, sf_dir, "inference_result").select(F.regexp_extract("query_id", r"\d+", 0).cast("int").cast("string").alias("kb_code"))
    return fan_out(codes.where("kb_code is not null"), table(spark, sf_dir, "knowledge_base")).select("service", F.array_join("kb_codes", ",").alias("kb_codes"))


def questions_recall(spark, sf_dir):
    """For each question, its first word of at least eight characters in all live chunks."""
    word = F.get(F.filter(tokens("question"), lambda x: F.length(x) >= 8), F.lit(0))
    asked = table(spark, sf_dir, "inference_result").select(F.col("line_no").alias("query_id"), word.alias("text")).where("text is not null")
    return text_recall_batch(_live(spark, sf_dir), asked)


def questions_recall_words(spark, sf_dir):
    """For each question, the chunks with all its words of at least six characters, by cover density."""
    words = F.array_join(F.filter(tokens("question"), lambda x: F.length(x) >= 6), " ")
    return text_recall_batch(_live(spark, sf_dir), table(spark, sf_dir, "inference_result").select(F.col("line_no").alias("query_id"), words.alias("text")))


_LIVE = f"""live AS (SELECT c.kid AS chunk_id, c.knowledge_base_id::varchar AS kb_code, ltrim(f.virtual_path, '/') AS full_path, c.fs_entry_id, c.chunk_no, f.name,
  regexp_extract_all(lower(c.chunk_text), '{TOKEN_SQL}') AS tokens
  FROM knowledge_chunk c JOIN knowledge_fs_entry f ON f.kid = c.fs_entry_id AND f.entry_type = 'FILE' AND NOT f.is_deleted JOIN knowledge_base b ON b.kid = f.knowledge_base_id AND NOT b.is_deleted)"""
_TEXT = "SELECT chunk_id, len(list_filter(tokens, lambda x: x = '{0}')) * 0.1::double AS text_score FROM {1} WHERE list_contains(tokens, '{0}')"
_VECTOR = """SELECT l.chunk_id, list_cosine_similarity(e.embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)) AS vector_score
  FROM {0} l JOIN embeddings e ON e.vec_id = l.chunk_id"""


def _search_sql(term: str, text_k: int, vector_k: int, source: str = "live", tail: str = "") -> str:
    return f"""WITH {_LIVE}, chosen AS (SELECT * FROM live WHERE {tail or 'true'}),
t AS ({_TEXT.format(term, "chosen")} ORDER BY text_score DESC, chunk_id DESC LIMIT {text_k}), v AS ({_VECTOR.format("chosen")} ORDER BY vector_score DESC, chunk_id DESC LIMIT {vector_k}),
n AS (SELECT (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM v) AS v),
fused AS (SELECT chunk_id, CASE WHEN n.t = 0 OR n.v = 0 THEN coalesce(text_score, 0) + coalesce(vector_score, 0) ELSE coalesce(text_score, 0) * 0.4::double + coalesce(vector_score, 0) * 0.6::double END
  + CASE WHEN coalesce(text_score, 0) <> 0 AND coalesce(vector_score, 0) <> 0 THEN 0.05::double ELSE 0 END AS score FROM t FULL JOIN v USING (chunk_id), n) """


_TOP = "SELECT chunk_id, kb_code, '/' || full_path AS file_path, chunk_no, round(score, 6) AS score FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id DESC LIMIT 10) JOIN live USING (chunk_id)"


def queries() -> dict:
    return {f.__name__: f for f in (hybrid_search_topk, text_recall_topk, text_recall_all, text_recall_two_terms, hybrid_dual_hit_bonus, text_recall_cover_density, vector_recall_topk, hybrid_one_side_empty, hybrid_with_filter, search_file_max_score, vector_nearest_batch, federated_merge_hits,
        federated_order, hybrid_in_bases, hybrid_search_complete, file_type_filter, distinct_chunk_hits, service_fan_out, questions_recall, questions_recall_words)}


def oracle_sql() -> dict[str, str]:
    merged = f"WITH {_LIVE}, hits AS (SELECT kb_code, chunk_id, text_score FROM ({_TEXT.format(TERM, 'live')}) JOIN live USING (chunk_id)), allowed AS (SELECT kid::varchar AS kb_code FROM knowledge_base WHERE NOT is_deleted AND kb_description IS NOT NULL)"
    shown = links._state_sql().replace("WITH ", ", ", 1)
    latest = search._LATEST
    return {
        # Two terms: the shortest spans with both lie between neighbouring occurrences of different ones.
        "text_recall_two_terms": f"""WITH {_LIVE}, w AS (SELECT chunk_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS place FROM live),
            k AS (SELECT *, lag(term) OVER o AS before, lag(place) OVER o AS prev FROM w WHERE term IN ('audit', 'trail') WINDOW o AS (PARTITION BY chunk_id ORDER BY place))
            SELECT chunk_id, round(sum(0.1::double / (place - prev)), 6) AS text_score FROM k WHERE term <> before GROUP BY ALL""",
        "hybrid_dual_hit_bonus": f"WITH {_LIVE}, t AS ({_TEXT.format(TERM, 'live')}), v AS ({_VECTOR.format('live')}) SELECT chunk_id, round(text_score, 6) AS text_score, round(vector_score, 6) AS vector_score, round(text_score * 0.4::double + vector_score * 0.6::double + 0.05::double, 6) AS score FROM t JOIN v USING (chunk_id) WHERE text_score <> 0 AND vector_score <> 0",
        "federated_order": merged + """ SELECT * FROM (SELECT kb_code, chunk_id, round(text_score, 6) AS score, false AS is_error FROM hits SEMI JOIN allowed USING (kb_code) UNION ALL SELECT DISTINCT kb_code, NULL::bigint, NULL::double, true FROM hits ANTI JOIN allowed USING (kb_code))
            ORDER BY is_error DESC, score DESC NULLS LAST, chunk_id DESC NULLS LAST, kb_code LIMIT 40""",
        "hybrid_in_bases": _search_sql(TERM, 30, 40, tail="kb_code IN ('3', '7', '11')") + _TOP,
        "hybrid_search_complete": _search_sql(TERM, 600, 800) + shown + f""", best AS (SELECT chunk_id, score FROM fused ORDER BY score DESC, chunk_id DESC LIMIT 200), latest AS ({latest})
            SELECT b.chunk_id, l.kb_code, '/' || l.full_path AS file_path, l.chunk_no, c.start_line, c.end_line, coalesce(s.shown, '') || ' ' || c.chunk_text AS chunk_text, round(b.score, 6) AS score, m.value.x AS review_state, r.value.x AS revision
            FROM best b JOIN live l USING (chunk_id) JOIN knowledge_chunk c ON c.kid = b.chunk_id LEFT JOIN (SELECT DISTINCT * FROM shown) s ON s.kid = b.chunk_id % 500 AND s.base = c.knowledge_base_id
            LEFT JOIN latest m ON m.kid = l.fs_entry_id AND m.property_name = 'review_state' LEFT JOIN latest r ON r.kid = l.fs_entry_id AND r.property_name = 'revision'""",
        "file_type_filter": f"WITH {_LIVE} SELECT kb_code, count(*) AS n FROM live WHERE contains(full_path, '.') AND lower(regexp_extract(full_path, '[^.]+$')) IN ('md', 'txt') GROUP BY ALL",
        "distinct_chunk_hits": f"WITH {_LIVE} SELECT chunk_id, round(max(text_score), 6) AS score FROM ({_TEXT.format(TERM, 'live')} UNION ALL {_TEXT.format('index', 'live')}) GROUP BY ALL",
        "service_fan_out": """SELECT service, string_agg(kb_code, ',' ORDER BY kb_code) AS kb_codes FROM (SELECT DISTINCT c.kb_code, b.kb_name AS service FROM (SELECT TRY_CAST(regexp_extract(query_id, '\\d+') AS int)::varchar AS kb_code FROM inference_result) c
            LEFT JOIN knowledge_base b ON b.kid::varchar = c.kb_code AND NOT b.is_deleted WHERE c.kb_code IS NOT NULL) GROUP BY ALL""",
        "questions_recall": f"""WITH {_LIVE}, q AS (SELECT line_no AS query_id, list_filter(regexp_extract_all(lower(question), '{TOKEN_SQL}'), lambda x: length(x) >= 8)[1] AS term FROM inference_result),
            w AS (SELECT chunk_id, unnest(tokens) AS term FROM live), n AS (SELECT term, chunk_id, count(*) AS c FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL)
            SELECT query_id, chunk_id, text_score, rank FROM (SELECT query_id, chunk_id, round(c * 0.1::double, 6) AS text_score, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id DESC)::int AS rank FROM (SELECT DISTINCT * FROM q) JOIN n USING (term)) WHERE rank <= 20""",
        "hybrid_search_topk": _search_sql(TERM, 30, 40) + _TOP,
        "text_recall_topk": _search_sql(TERM, 30, 0) + _TOP,
        "text_recall_all": f"WITH {_LIVE} SELECT chunk_id, round(text_score, 6) AS text_score FROM ({_TEXT.format(TERM, 'live')})",
        "vector_recall_topk": _search_sql(TERM, 0, 40) + _TOP,
        "hybrid_one_side_empty": _search_sql("nosuchword", 30, 40) + _TOP,
        "hybrid_with_filter": _search_sql(TERM, 30, 40, tail="lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('md', 'txt')") + _TOP,
        "search_file_max_score": _search_sql(TERM, 500, 500) + "SELECT kb_code, full_path, round(max(score), 6) AS score, count(*) AS hits FROM fused JOIN live USING (chunk_id) GROUP BY kb_code, full_path ORDER BY max(score) DESC, max(chunk_id) DESC LIMIT 10",
        "vector_nearest_batch": """SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) AS s,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) DESC, v.vec_id DESC)::int AS rank
            FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
        "federated_merge_hits": merged + " SELECT kb_code, chunk_id, round(text_score, 6) AS score, false AS is_error FROM hits SEMI JOIN allowed USING (kb_code) UNION ALL SELECT DISTINCT kb_code, NULL::bigint, NULL::double, true FROM hits ANTI JOIN allowed USING (kb_code)",
    }

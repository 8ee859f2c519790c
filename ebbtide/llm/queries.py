"""The thin queries of this package, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import chats, langid, leaks, minhash, mixing, passages, quality, suffixes, tokens, vectors


VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Target weights of the mixture; every other source shares one weight of 1.
TARGET = {"src0": 6, "src1": 4, "src2": 4, "src3": 3, "src4": 3, "src5": 2, "src6": 2, "src7": 2, **{f"src{i}": 1 for i in range(8, 20)}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated(_table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_words")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, TARGET)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), VOCABULARY)


#: The tools that tool_dialogue() calls: (name, parameter, type, required).
TOOLS = [("measure", "chars", "integer", True), ("measure", "after", "string", False)]


def tool_dialogue(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with a call and a result besides every assistant's message.

    The call c<turn> measures the message and needs the one of two turns before; the message's length decides what is wrong with it: a tool that
    isn't listed (divisible by 5), a number as text (3), an unknown argument (7), a missing one (11), no result (13).
    """
    n, turn = F.length(F.coalesce("text", F.lit(""))), F.col("turn").cast("string")
    chars = F.when(n % 11 != 0, F.concat(F.lit('"chars":'), F.when(n % 3 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))))
    after = F.when(F.col("turn") >= 2, F.concat(F.lit('"after":"${c'), (F.col("turn") - 2).cast("string"), F.lit('}"')))
    args = F.concat_ws(",", chars, F.when(n % 7 == 0, '"note":"x"'), after)
    name = F.when(n % 5 == 0, "unlisted").otherwise("measure")
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), turn, F.lit('","name":"'), name, F.lit('","arguments":{'), args, F.lit("}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"c'), turn, F.lit('","content":"'), F.md5(F.coalesce("text", F.lit(""))), F.lit('"}'))
    own = F.struct("role", "text")
    more = F.array(own, F.struct(F.lit("assistant").alias("role"), call.alias("text")), F.when(n % 13 != 0, F.struct(F.lit("tool").alias("role"), result.alias("text"))))
    rows = F.when(F.col("role") == "assistant", F.array_compact(more)).otherwise(F.array(own))
    return conversations.select("conv_id", "turn", F.explode(rows).alias("m")).select("conv_id", "turn", "m.*")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{name}', '{parameter}', '{kind}', {str(required).lower()})" for name, parameter, kind, required in TOOLS)
    schemas = spark.sql(f"SELECT * FROM VALUES {values} AS t(name, parameter, type, required)")  # no Python rows
    rows = chats.formatted(tool_dialogue(_table(spark, sf_dir, "conversations")), schemas)
    return rows.withColumn("problems", F.array_join("problems", ","))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents)"""
_REACH = """reach(node, other) AS (SELECT id, id FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other), comp AS (SELECT node, min(other) component FROM reach GROUP BY node)"""

_NEAR = f"""WITH RECURSIVE {_WORDS},
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2])
   WHEN len(ws) > 0 THEN [array_to_string(ws, chr(1))] END) sh FROM w),
 n AS (SELECT d.doc_id, count(s.sh) n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
 p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
 nodes AS (SELECT doc_id id FROM n), {_REACH}
SELECT doc_id, n AS n_shingles, component AS component_id, doc_id = component AS kept FROM n JOIN comp ON node = doc_id"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings),
 ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) size FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 links AS (SELECT x.vec_id a, y.vec_id b FROM ok x JOIN ok y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
   WHERE x.size > 0 AND y.size > 0 AND list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.93),
 nodes AS (SELECT vec_id id FROM v), {_REACH}, n AS (SELECT a, count(*) n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept FROM v JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id"""

_REPEATED = f"""WITH {_WORDS},
 g AS (SELECT doc_id, unnest(range(0, len(ws) - 49)) i, unnest(list_transform(range(1, len(ws) - 48), lambda k: md5(array_to_string(list_slice(ws, k, k + 49), chr(1))))) h FROM w WHERE len(ws) >= 50),
 many AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
 r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END fresh FROM g JOIN many USING (h) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) run FROM r)
SELECT doc_id, min(i) AS start, max(i) + 50 AS "end", max(i) + 50 - min(i) AS n_words FROM k GROUP BY doc_id, run"""


_CHATS = '''WITH a AS (SELECT conv_id, turn, md5(coalesce(text, '')) h, length(coalesce(text, '')) n FROM conversations WHERE role = 'assistant'),
 c AS (SELECT a.*, 'c' || turn id, n % 5 = 0 odd, EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2) met FROM a),
 r AS (
  SELECT conv_id, turn, 0 place, 'message' kind, NULL::VARCHAR call_id, json_object('content', text, 'role', role)::VARCHAR j, '' problems FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'call', id,
   '{"arguments":{' || concat_ws(',', CASE WHEN turn >= 2 THEN '"after":"${c' || (turn - 2) || '}"' END,
     CASE WHEN n % 11 <> 0 THEN '"chars":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END END, CASE WHEN n % 7 = 0 THEN '"note":"x"' END)
    || '},"id":"' || id || '","name":"' || CASE WHEN odd THEN 'unlisted' ELSE 'measure' END || '","role":"assistant"}',
   concat_ws(',', CASE WHEN n % 11 = 0 AND NOT odd THEN 'missing_argument' END, CASE WHEN n % 13 = 0 THEN 'no_result' END,
    CASE WHEN n % 7 = 0 AND NOT odd THEN 'unknown_argument' END, CASE WHEN turn >= 2 AND NOT met THEN 'unknown_need' END,
    CASE WHEN odd THEN 'unknown_tool' END, CASE WHEN n % 3 = 0 AND n % 11 <> 0 AND NOT odd THEN 'wrong_type' END) FROM c
  UNION ALL SELECT conv_id, turn, 2, 'result', id, '{"content":"' || h || '","role":"tool","tool_call_id":"' || id || '"}', '' FROM c WHERE n % 13 <> 0)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY place, j) - 1 AS step, kind, call_id, j AS json, problems FROM r'''


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": _NEAR, "op3_suffix_dedup": _REPEATED, "op4_mixing": mixing.mixed_sql(TARGET), "op6_chat_format": _CHATS, "op7_embedding_near_dedup": _VECTORS,
    }

"""The registered queries of this subpackage, each over its whole table, and their checking SQL."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.llm import alignment, bitslice, chat, langid, lines, lm, mixing, packing, phrases, quality, simhash, spans, warc
from spendweave.llm.common import table
from spendweave.session import shared_dir


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


TOKENIZER = os.environ.get("TOKENIZER_PATH") or vocabulary("word_bpe_49k.json")
#: Weights of the mixture: good text mostly, poor text about as much as there is, little that is toxic.
WEIGHTS = {"good": 0.84, "poor": 0.14, "toxic": 0.02}


def conversation_records(turns: DataFrame) -> DataFrame:
    """``conv_id, record``: each conversation as JSON in one of the layouts that can hold its roles, by a hash of its id."""
    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = ordered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # one record is one row in the end
    roles, pick = F.transform("t", lambda x: x["role"]), F.pmod(F.xxhash64("conv_id"), F.lit(3))
    text = lambda k: F.get("t", F.lit(k))["text"]

    def listed(role: str, body: str, names: dict[str, str]) -> Column:
        named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        return F.transform("t", lambda x: F.struct((F.coalesce(F.element_at(named, x["role"]), x["role"]) if names else x["role"]).alias(role), x["text"].alias(body)))

    pair = lambda a, b: F.to_json(F.struct(text(0).alias(a), text(1).alias(b)))
    messages = F.to_json(F.struct(listed("role", "content", {}).alias("messages")))
    shared = F.to_json(F.struct(listed("from", "value", {"user": "human", "assistant": "gpt"}).alias("conversations")))
    dialogue = F.to_json(F.struct(F.struct(listed("speaker", "utterance", {"user": "prompter", "assistant": "bot"}).alias("turns")).alias("data")))
    plain = F.size(F.array_except(roles, F.array(F.lit("user"), F.lit("assistant"), F.lit("system")))) == 0
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.when(pick == 0, pair("prompt", "response")).when(pick == 1, pair("question", "answer")).otherwise(pair("instruction", "output")))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(plain & (pick == 1), shared).when(plain & (pick == 2), dialogue).otherwise(messages)
    )
    return held.select("conv_id", record.alias("record"))


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Everything is read back from the formatted text and its mask."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(control).alias("text"))
    extra = extra.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in given.schema.fields])
    out = chat.format_chat(conversation_records(given.unionByName(extra)), "conv_id", "record")
    turns, loss = chat.read_turns(F.col("formatted")), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_runs")), "")
    read = out.select("id", "layout", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS shown,
         replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n') AS shown_role FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(shown) + length(shown_role) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = bitslice.quantised(table(spark, folder, "embeddings"))
    return bitslice.search(rows, rows.where("vec_id % 50 = 0"), 5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, embedding, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, d, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM v),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM q a JOIN q b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_removed", "text")


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i,
         len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
p AS (SELECT *, i >= 1 AND (31 * lag(h) OVER w + h) % 4 = 0 AS proposed FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(proposed AND NOT lag(proposed) OVER w AND i < n - 2, false) AS cut FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
k AS (SELECT doc_id, chunk, min(i) AS first_line, string_agg(line, chr(10) ORDER BY i) AS body FROM g WHERE n >= 2 GROUP BY doc_id, chunk),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first_line) AS turn FROM k WHERE regexp_matches(body, '[^\x20\x09-\x0D]'))
SELECT d.doc_id, coalesce(x.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT g.doc_id, count(*) FILTER (WHERE r.turn > 1) AS n_removed,
         string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.turn IS NULL OR r.turn = 1) AS kept
  FROM g LEFT JOIN r ON g.doc_id = r.doc_id AND g.chunk = r.chunk GROUP BY g.doc_id) x ON d.doc_id = x.doc_id
"""


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("lang", "source")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ln AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS turn
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) FILTER (WHERE turn > 1) AS n FROM ln GROUP BY doc_id),
wi AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
tw AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wi) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM tw) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dl ON d.doc_id = dl.doc_id LEFT JOIN rw ON d.doc_id = rw.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'length', 'dup_lines', 'repeats']) AS measure,
         unnest([1000 * n_symbols // greatest(word_chars, 1), 100 * word_chars // greatest(n_words, 1),
                 1000 * n_dup_lines // greatest(n_words, 1), 1000 * n_repeat_words // greatest(n_words, 1)]) AS value FROM b),
s AS (
  SELECT lang, source, measure, value - value % (1::BIGINT << greatest(length(bin(value)) - 6, 0)::BIGINT) AS bucket, count(*) AS n
  FROM v WHERE NOT base_failed GROUP BY ALL),
g AS (
  SELECT 1 AS level, lang, source, measure, bucket, n FROM s
  UNION ALL SELECT 2, lang, NULL, measure, bucket, sum(n) FROM s GROUP BY lang, measure, bucket
  UNION ALL SELECT 3, NULL, NULL, measure, bucket, sum(n) FROM s GROUP BY measure, bucket),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS docs FROM g),
q AS (
  SELECT level, lang, source, measure, max(docs) AS docs, min(bucket) FILTER (WHERE upto * 4 >= docs) AS q1,
         min(bucket) FILTER (WHERE upto * 4 >= 3 * docs) AS q3 FROM c GROUP BY ALL),
f AS (
  SELECT level, lang, source, measure, docs, CASE measure WHEN 'length' THEN q1 - (4 * (q3 - q1) + 250) ELSE 0 END AS low,
         q3 + 4 * (q3 - q1) + CASE measure WHEN 'symbols' THEN 30 WHEN 'length' THEN 250 WHEN 'dup_lines' THEN 20 ELSE 250 END AS high FROM q),
t AS (
  SELECT a.lang, a.source, a.measure, CASE WHEN a.docs >= 100 THEN a.low WHEN b.docs >= 100 THEN b.low ELSE z.low END AS low,
         CASE WHEN a.docs >= 100 THEN a.high WHEN b.docs >= 100 THEN b.high ELSE z.high END AS high
  FROM f a JOIN f b ON b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure
  JOIN f z ON z.level = 3 AND a.measure = z.measure WHERE a.level = 1),
k AS (
  SELECT v.doc_id, bool_and(coalesce(v.value BETWEEN t.low AND t.high, false)) AS within
  FROM v LEFT JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.measure = t.measure GROUP BY v.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept
FROM b JOIN k ON b.doc_id = k.doc_id
"""


def op7_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spans.dedup_spans(docs).select("doc_id", "n_removed", "text")


OP7_SQL = r"""
WITH p AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?]+|[^.!?\n]+|\n')) AS piece,
         generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?]+|[^.!?\n]+|\n'), 1) AS n
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i,
         list_filter(regexp_split_to_array(piece, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM p WHERE regexp_matches(piece, '[^\x20\x09-\x0D.!?]')),
c AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s),
r AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + 8
  WHERE b.upto - a.upto + len(a.w) >= 8 GROUP BY a.doc_id, a.i),
k AS (
  SELECT r.doc_id, r.i, r.j, string_agg(array_to_string(w, ' '), chr(10) ORDER BY c.i) AS body
  FROM r JOIN c ON r.doc_id = c.doc_id AND c.i BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j),
t AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS turn FROM k),
g AS (SELECT DISTINCT c.doc_id, c.n FROM t JOIN c ON t.doc_id = c.doc_id AND c.i BETWEEN t.i AND t.j WHERE t.turn > 1),
x AS (
  SELECT p.doc_id, count(g.n) AS n_removed, string_agg(piece, '' ORDER BY p.n) FILTER (WHERE g.n IS NULL) AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.n = g.n GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(x.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.kept, '') END AS text
FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id
"""


def domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of labelled documents: toxic, else good or poor."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", kind.alias("domain"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), domains(table(spark, folder, "labels"))
    return mixing.mix(docs, labels, WEIGHTS).select("doc_id", "tokens", "domain", "p", "rate", "copies")


def op9_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archives are written to the shared folder and read back; every row comes from the records read."""
    archives = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.resolved(warc.read_archives(spark, archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, count(*) OVER w AS n, max(page_id) OVER w AS top FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))),
r AS (SELECT *, strlen(h) >= 1000 AND n > 1 AND top IS NOT NULL AND coalesce(page_id < top, true) AS later FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN later THEN top END AS refers_to
FROM r
"""


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k >= 2),
u AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT u.lang, u.phrase, u.k, u.a, j, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * u.a // (x.a + y.a) AS BIGINT) AS score
  FROM u JOIN f x ON u.lang = x.lang AND x.phrase = array_to_string(u.w[1:j], ' ') JOIN f y ON u.lang = y.lang AND y.phrase = array_to_string(u.w[j+1:u.k], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS turn FROM s),
i AS (
  SELECT lang, array_to_string(w[x:x+m-1], ' ') AS phrase, max(a) AS around
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS x FROM c, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL),
r AS (
  SELECT b.lang, b.phrase, b.a, l, r, t.n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b JOIN t ON b.lang = t.lang LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE turn = 1 AND NOT coalesce(100::HUGEINT * i.around >= 80::HUGEINT * b.a, false))
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat, "op2_topk": op2_topk, "op3_simhash": op3_simhash, "op4_language": op4_language, "op5_lines": op5_lines, "op6_quality": op6_quality, "op7_spans": op7_spans, "op8_mixing": op8_mixing, "op9_scoring": op9_scoring, "op10_packing": op10_packing,
    "op11_warc": op11_warc, "op12_phrases": op12_phrases, "op13_alignment": op13_alignment, "pipeline": pipeline,
}
CHECKS: dict[str, str] = {"op1_chat": OP1_SQL, "op2_topk": OP2_SQL, "op5_lines": OP5_SQL, "op6_quality": OP6_SQL, "op7_spans": OP7_SQL, "op11_warc": OP11_SQL, "op12_phrases": OP12_SQL}

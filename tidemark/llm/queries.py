"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, chat_format, edit_fingerprint, html_extract, mixing, near_dedup, piece_bpe, quality_crf, spelling, suffix_dedup, target_sampling, toxicity
from tidemark.llm._spark import table

#: The public tokenizers that texts are encoded with.
TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
#: Scores from which a document counts as good, and as toxic.
THRESHOLD = 0.3
#: The mixture: weights at each level of the tree.
WEIGHTS = {"domain": {"web": 4, "reference": 3, "forum": 3}, "lang": {"en": 14, "de": 3, "fr": 3, "es": 2}, "source": {}}
EPOCHS, SEED = 2, 17


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a tokenizer's file is; it is read by the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def mixture_levels() -> dict[str, Column]:
    """Domain, language and source of a document; domains are declared by source."""
    domain = F.when(F.col("source") == "src0", "web").when(F.col("source").rlike("^src[1-9]$"), "reference").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def learnable(labels: DataFrame, modulus: int, held: int) -> DataFrame:
    """Labels that may be learned from: all but those of documents that are held out by a checksum of their id."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) != held)


def _judged(scores: DataFrame, modulus: int, held: int, *more: str) -> DataFrame:
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == held
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *more)


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, numerator=85, denominator=100)


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def edit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of those that are near by their edit fingerprints."""
    return edit_fingerprint.near_by_edits(table(spark, sf_dir, "documents")).select("doc_id", "component_id")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word spans of repeated passages; ``later``: the parts that a document with a smaller id has too."""
    spans = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(F.col("id").alias("doc_id"), F.col("begin").alias("first_word"), F.col("finish").alias("end_word"), "later")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality_crf.fit(docs, learnable(table(spark, sf_dir, "labels"), 5, 0))
    return _judged(quality_crf.score(docs, field), 5, 0)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted = chat_format.format_chat(chat_format.canonical_turns(rows.unionByName(extra)))
    back = chat_format.read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` as JSON records, dealt to three layouts with fields beside them, and mapped back."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("t"))
    other = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    layouts = [
        F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.lit(1).alias("version")),
        F.struct(F.transform("t", lambda x: F.struct(F.coalesce(other[x["role"]], x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"), F.lit("x").alias("prompt")),
        F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")),
    ]
    kind = F.pmod("conv_id", F.lit(3))
    record = F.when(kind == 0, F.to_json(layouts[0])).when(kind == 1, F.to_json(layouts[1])).otherwise(F.to_json(layouts[2]))
    found = chat_format.canonical_turns(rows.select("conv_id", record.alias("record")), record_col="record")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, learnable(table(spark, sf_dir, "labels"), 4, 2))
    return _judged(toxicity.score(docs, lexicon), 4, 2, "hits")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), mixture_levels(), WEIGHTS, epochs=EPOCHS, seed=SEED)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"))


def op11_piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {"edit_links": edit_links, "chat_layouts": chat_layouts, "pipeline": pipeline}


#: All pairs that share a shingle, then the components of the links: too slow for large tables, exact for small ones.
_OP2_SQL = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT p, q FROM b JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.q FROM r JOIN e ON e.p = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_OP8_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  CAST(sum(14 + length(role) + length(text) + length(role) - length(regexp_replace(role, '[\\<#:]', '', 'g')) + length(text) - length(regexp_replace(text, '[\\<#:]', '', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a"""


_LAYOUTS_SQL = """SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256 FROM conversations GROUP BY conv_id"""


def _level_sql(level: str, above: str, keys: str, weight: str) -> str:
    """One level of the water filling, as a chain of CTEs from ``{above}`` (budget b of each parent) to ``{level}``."""
    parent = keys.rpartition(", ")[0]
    by = f"PARTITION BY {parent}" if parent else ""
    on = f"USING ({parent})" if parent else "ON true"
    last = keys.rpartition(", ")[2]
    return f"""{level}0 AS (SELECT {keys}, CAST(sum(tokens * {EPOCHS}) AS BIGINT) AS c, {weight} AS w FROM leaf GROUP BY {keys}),
{level}1 AS (SELECT x.*, p.b AS given, coalesce(sum(c) OVER (ORDERED ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(CASE WHEN c > 0 THEN w ELSE 0 END) OVER (ORDERED ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
  FROM {level}0 x JOIN {above} p {on}),
{level}2 AS (SELECT *, c > 0 AND c * wl <= w * (given - before) AS f FROM {level}1),
{level}3 AS (SELECT *, sum(CASE WHEN f THEN c ELSE 0 END) OVER ({by}) AS taken, sum(CASE WHEN f OR c = 0 THEN 0 ELSE w END) OVER ({by}) AS wo FROM {level}2),
{level} AS (SELECT {keys}, CAST(CASE WHEN f THEN c WHEN c = 0 THEN 0 ELSE ((given - taken) * w) // wo END AS BIGINT) AS b FROM {level}3)""".replace("ORDERED", f"{by} ORDER BY CASE WHEN c > 0 THEN CAST(c AS DOUBLE) / w ELSE CAST('inf' AS DOUBLE) END, {last}")


def _op10_sql() -> str:
    def weight(name: str) -> str:
        cases = " ".join(f"WHEN {name} = '{v}' THEN {w}" for v, w in WEIGHTS[name].items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    levels = [_level_sql("l1", "root", "domain", weight("domain")), _level_sql("l2", "l1", "domain, lang", weight("lang")), _level_sql("l3", "l2", "domain, lang, source", weight("source"))]
    return rf"""WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'reference' ELSE 'forum' END AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS t FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(t) AS BIGINT) AS tokens FROM d GROUP BY ALL), root AS (SELECT CAST(sum(tokens) AS BIGINT) AS b FROM leaf),
{", ".join(levels)},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS full_passes, b - CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END * tokens AS rest FROM leaf JOIN l3 USING (domain, lang, source)),
k AS (SELECT d.*, full_passes, rest, sum(t) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || CAST(full_passes + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), t ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p USING (domain, lang, source)),
z AS (SELECT *, unnest(range(1, CAST(full_passes + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END + 1 AS BIGINT))) AS epoch FROM k)
SELECT doc_id, domain, lang, source, epoch, t AS n_tokens FROM z"""


#: CRC-32 of a text, byte by byte over the table of its polynomial.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc_t)"


def _crc_sql(text: str) -> str:
    bytes_of = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_of}), lambda x, b: xor(x >> 8, crc_t[CAST((xor(x, b) & 255) + 1 AS INT)])), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP12_SQL = rf"""WITH {_CRC_TABLE},
d AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
g AS (SELECT kind, id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM w),
h AS (SELECT f, CAST({_crc_sql("f")} % 10000 AS INT) AS bucket FROM (SELECT DISTINCT f FROM g), crc),
b AS (SELECT kind, id, bucket, count(*) AS n FROM g JOIN h USING (f) GROUP BY ALL),
c AS (SELECT bucket, sum(CASE WHEN kind = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN kind = 1 THEN n ELSE 0 END) AS t FROM b GROUP BY bucket),
a AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM c),
e AS (SELECT bucket, CAST(floor(1000 * ln((c.t + 1.0::DOUBLE) * (a.s + 10000) / ((c.s + 1.0::DOUBLE) * (a.t + 10000)))) AS BIGINT) AS gain FROM c, a),
v AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM b JOIN e USING (bucket) WHERE kind = 0 GROUP BY id),
o AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS open,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(w.id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN v USING (id) WHERE kind = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY open) AS many FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= 5 * many // 100 THEN place END AS rank FROM r"""

_OP13_SQL = rf"""WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT run, n, {_crc_sql("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM c, crc),
t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT DISTINCT x.word AS a, x.n AS an, y.word AS b, y.n AS bn FROM v x JOIN v y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
  UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.cut = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.cut = w.word),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS place, count(*) OVER (PARTITION BY a) AS near FROM p),
f AS (SELECT w.word, w.n, coalesce(near, 0) AS n_near, CASE WHEN bn >= 10 * w.n THEN b END AS form, CASE WHEN bn >= 10 * w.n THEN bn END AS form_n FROM w LEFT JOIN k ON k.a = w.word AND k.place = 1),
r AS (SELECT word, word AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f AS e ON e.word = r.root AND e.form IS NULL"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the tests hold the others against brute force."""
    return {"op2_minhash_near_dedup": _OP2_SQL, "op8_chat_format": _OP8_SQL, "chat_layouts": _LAYOUTS_SQL, "op10_source_mixing": _op10_sql(), "op12_target_resampling": _OP12_SQL, "op13_spelling_variants": _OP13_SQL}

"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ann, decontaminate, fingerprint_index, license_scan, line_windows, packing, reply_trees, simhash_tiles, url_reputation, zstd_langid
from ._common import documents

#: The conversation that the contract adds.
PROBE = "</s>[INST] ok [/INST]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(read(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter("id % 50 = 0"), k=5)


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return url_reputation.judge(read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op3_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.remove_repeats(documents(spark, sf_dir), fanout=1).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_windows.remove_later_windows(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def held_out():
    """The documents of which nothing may be learned."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op5_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = zstd_langid.identify(docs.select("doc_id", "text"), zstd_langid.fit(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """The rows of each conversation as a chain of replies, in order of their turns: one leaf, so nothing is left to rank."""
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("tree_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    return own.withColumn("node_id", F.row_number().over(order).cast("long")).select(
        "tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = reply_trees.with_loss_text(reply_trees.format_trees(conversation_nodes(own.unionByName(probe))))
    turns = reply_trees.parse(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("turns", turns).select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tiles.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer_path()))


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_learned_partitions,
        op2_host_reputation,
        op3_fingerprint_index,
        op4_line_windows,
        op5_zstd_language,
        op6_decontamination,
        op7_reply_trees,
        op8_simhash_tiles,
        op9_best_fit_packing,
        op10_license_diagonals,
        pipeline,
    )
}

_NAME = "regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '')"


def _tail(n: int) -> str:
    return f"array_to_string(string_split(name, '.')[-{n}:], '.')"


_ADDRESS = r"regexp_matches(name, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$')"
_PUBLIC = (
    f"({_tail(2)} IN ({', '.join(repr(x) for x in url_reputation.HOSTING)}) OR regexp_matches({_tail(1)}, '^[a-z]{{2}}$') "
    f"AND contains(name, '.') AND string_split({_tail(2)}, '.')[1] IN ({', '.join(repr(x) for x in url_reputation.SECOND_LEVEL)}))"
)


def _rules(column: int) -> str:
    cases = []
    for rule, verdict in sorted(url_reputation.RULES, key=lambda x: (-len(x[0]), x[0])):
        h, p = rule.split("/", 1)
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{(rule, verdict)[column]}'")
    return f"CASE {' '.join(cases)} END"


def _weight(table: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(room, 0) = 0 OR seen <= noise THEN most ELSE least(greatest(room / (seen - noise) - 1, 1.0), most) END FROM (
        SELECT sum((bad / n - prior) * (bad / n - prior)) AS seen, sum(prior * (1 - prior) / n) AS noise, sum(prior * (1 - prior) * (1 - 1.0 / n)) AS room, greatest(10.0, coalesce(avg(n), 0.0)) AS most
        FROM {table} WHERE n > 0))"""


SQL = {
    "op2_host_reputation": f"""
WITH split AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS has, substr(url, instr(url, '://') + 3) AS rest FROM pages WHERE page_id IS NOT NULL
), own AS (
  SELECT page_id, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM split
), marks AS (SELECT doc_id, count(*) AS n, sum(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
), counted AS (
  SELECT host, CAST(sum(coalesce(n, 0)) AS DOUBLE) AS n, CAST(sum(coalesce(bad, 0)) AS DOUBLE) AS bad, {_NAME} AS name FROM own LEFT JOIN marks ON page_id = doc_id GROUP BY host
), hosts AS (
  SELECT host, n, bad, CASE WHEN {_ADDRESS} THEN name WHEN {_PUBLIC} THEN {_tail(3)} ELSE {_tail(2)} END AS domain,
    CASE WHEN {_ADDRESS} THEN '{url_reputation.ADDRESS}' WHEN {_PUBLIC} THEN {_tail(2)} ELSE {_tail(1)} END AS suffix FROM counted
), rate AS (SELECT (coalesce(sum(bad), 0) + CAST(0.05 AS DOUBLE)) / (coalesce(sum(n), 0) + CAST(1.0 AS DOUBLE)) AS overall FROM hosts
), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT overall FROM rate) AS prior FROM hosts GROUP BY suffix
), s1 AS (SELECT suffix, (bad + prior * w) / (n + w) AS mean FROM s0, (SELECT {_weight('s0')} AS w)
), d0 AS (SELECT h.suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS prior FROM hosts h JOIN s1 ON h.suffix = s1.suffix GROUP BY h.suffix, domain
), d1 AS (SELECT suffix, domain, (bad + prior * w) / (n + w) AS mean FROM d0, (SELECT {_weight('d0')} AS w)
), h0 AS (SELECT host, n, bad, mean AS prior FROM hosts h JOIN d1 ON h.suffix = d1.suffix AND h.domain = d1.domain
), h1 AS (SELECT host, (bad + prior * w) / (n + w) AS mean, n + w AS total FROM h0, (SELECT {_weight('h0')} AS w))
SELECT page_id, own.host AS host, path, {_rules(0).replace('host', 'own.host')} AS rule,
  coalesce({_rules(1).replace('host', 'own.host')}, CASE WHEN mean - sqrt(mean * (1 - mean) / (total + 1)) > (SELECT overall FROM rate) THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN h1 ON own.host = h1.host""",
    "op3_fingerprint_index": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents WHERE doc_id IS NOT NULL
), win AS (SELECT doc_id, i0, md5(array_to_string(list_slice(words, i0, i0 + 34), ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i0 FROM w)
), rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1
), hit AS (SELECT DISTINCT doc_id, i0 + k AS pos FROM win JOIN rep USING (h), range(35) r(k)
), gone AS (SELECT doc_id, list(pos) AS gone FROM hit GROUP BY doc_id
), kept AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
), left_over AS (SELECT doc_id, k.pos AS pos, words[k.pos] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w) k ANTI JOIN hit USING (doc_id, pos)
), texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM left_over GROUP BY doc_id)
SELECT kept.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(texts.kept, '')) AS kept_sha256
FROM kept LEFT JOIN texts ON kept.doc_id = texts.doc_id""",
    "op4_line_windows": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL
), win AS (SELECT doc_id, i0, array_to_string(list_slice(lines, i0 + 1, i0 + 3), chr(10)) AS w FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS i0 FROM l)
), good AS (SELECT * FROM win WHERE trim(translate(w, chr(10) || chr(9) || chr(13), '   ')) <> ''
), ranked AS (SELECT doc_id, i0, row_number() OVER (PARTITION BY w ORDER BY doc_id, i0) AS k FROM good
), gone AS (SELECT DISTINCT doc_id, i0 + r.k AS pos FROM ranked, range(3) r(k) WHERE ranked.k > 1
), each_line AS (SELECT doc_id, pos, lines[pos + 1] AS line FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS pos FROM l)
), kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM each_line ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id AS doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept.kept, '')) END AS kept_sha256
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id LEFT JOIN n ON l.doc_id = n.doc_id""",
    "op6_decontamination": r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents WHERE doc_id IS NOT NULL
), items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), grams AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS m, array_to_string(list_slice(words, i0, i0 + least(len(words), 13) - 1), ' ') AS g
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS i0 FROM items WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT m FROM grams
), win AS (SELECT doc_id, m, i0, array_to_string(list_slice(words, i0, i0 + m - 1), ' ') AS g FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i0 FROM low, sizes WHERE len(words) >= m)
), hit AS (SELECT doc_id, win.m AS m, i0, item_id FROM win JOIN grams ON win.m = grams.m AND win.g = grams.g
), words_hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i0 + k AS pos FROM hit, range(13) r(k) WHERE k < m) GROUP BY doc_id
), by_doc AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT low.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(words_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(by_doc.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words_hit.n, 0) > 0 AND 20 * coalesce(words_hit.n, 0) >= len(words) AS contaminated
FROM low LEFT JOIN words_hit ON low.doc_id = words_hit.doc_id LEFT JOIN by_doc ON low.doc_id = by_doc.doc_id""",
}


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in reply_trees.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL["op7_reply_trees"] = f"""
WITH own AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM own
), g AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length({_escaped('role')}) + length({_escaped('text')}) + 23) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g"""

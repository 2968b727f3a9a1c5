"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import read_table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.pii import BASE_KINDS, find_personal_data, joined

    found = find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.dedup_blocks import exact_dedup

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(text_or_empty(), 256).alias("text_sha256"))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op4_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.mixing import systematic_mix

    from pointloom.llm.common import word_count

    docs = read_table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", word_count(text_or_empty()).alias("words"))
    mixed = systematic_mix(slim, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.common import materialize
    from pointloom.llm.rules import apply_rules, fit_rules, text_statistics

    stats = materialize(text_statistics(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "statistics")
    rules = fit_rules(stats, read_table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return apply_rules(stats, rules).select("doc_id", *counts, "base_failed", "kept")


def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.common import shared_path
    from pointloom.llm.external_shuffle import external_shuffle

    docs = read_table(spark, sf_dir, "documents")
    out = external_shuffle(docs, shared_path(spark, "shuffled"))
    return out.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.subword import fit, score

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs, read_table(spark, sf_dir, "labels").where(fold != 1))
    # The text goes through the scorer only as its input.
    scored = score(docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.parity_join import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tok AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words),
four AS (SELECT doc_id, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o AS sh FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
each AS (SELECT DISTINCT doc_id, sh FROM four WHERE sh IS NOT NULL
         UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(sh) AS n FROM documents LEFT JOIN each USING (doc_id) GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each a JOIN each b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS comp FROM sizes UNION SELECT b, comp FROM reach JOIN links ON a = node)
SELECT doc_id, n AS n_shingles, min(comp) AS component_id FROM sizes JOIN reach ON node = doc_id GROUP BY ALL
"""


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.preference import format_preferences, pairs_by_id

    turns = read_table(spark, sf_dir, "conversations")
    return format_preferences(turns, pairs_by_id(turns))


OP3_SQL = """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) - 1 AS rank
  FROM (SELECT DISTINCT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
               coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)),
both_sides AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.rank, r.rank) AS rank,
         c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text, c.pair_id IS NOT NULL AS has_c, r.pair_id IS NOT NULL AS has_r
  FROM (SELECT * FROM t WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM t WHERE side = 'rejected') r ON r.pair_id = c.pair_id AND r.turn = c.turn AND r.rank = c.rank),
marked AS (
  SELECT *, bool_or(has_c) OVER p AND bool_or(has_r) OVER p AS paired,
         count(*) FILTER (WHERE NOT coalesce(c_role = r_role AND c_text = r_text, false))
           OVER (PARTITION BY pair_id ORDER BY turn, rank) = 0 AS shared
  FROM both_sides WINDOW p AS (PARTITION BY pair_id)),
parts AS (
  SELECT pair_id, 'prompt' AS part, turn, rank, c_role AS role, c_text AS text, paired FROM marked WHERE shared
  UNION ALL SELECT pair_id, 'chosen', turn, rank, c_role, c_text, paired FROM marked WHERE has_c AND NOT shared
  UNION ALL SELECT pair_id, 'rejected', turn, rank, r_role, r_text, paired FROM marked WHERE has_r AND NOT shared),
rendered AS (
  SELECT pair_id, part, turn, rank, role, '<|' || role || '|>' || chr(10) AS head,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, paired FROM parts)
SELECT pair_id, part, turn, rank, role, rendered,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS train_from,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(rendered) ELSE 0 END AS BIGINT) AS train_to, paired
FROM rendered
UNION ALL
SELECT pair_id, side, NULL, NULL, NULL, '', 0, 0, paired
FROM (SELECT DISTINCT pair_id, paired FROM marked), (VALUES ('chosen'), ('rejected')) AS s(side)
WHERE (pair_id, side) NOT IN (SELECT (pair_id, part) FROM parts)
"""


def op7_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.secrets import scan_secrets

    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    spans = F.transform("secrets", lambda s: F.concat_ws(":", F.lit("secret"), s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_candidates", "n_secrets", F.array_join(spans, ",").alias("spans"))


def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.winnowing import decontaminate

    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


OP11_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, t, array_to_string(w[i:i + t - 1], ' ') AS win
                 FROM (SELECT item_id, w, least(10, len(w)) AS t, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
doc_windows AS (SELECT r, i, t, array_to_string(w[i:i + t - 1], ' ') AS win
                FROM (SELECT r, w, t, unnest(generate_series(1, len(w) - t + 1)) AS i FROM low, (SELECT DISTINCT t FROM item_windows) WHERE len(w) >= t)),
met AS (SELECT r, i, d.t AS t, item_id FROM doc_windows d JOIN item_windows USING (win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + t - 1)) AS p FROM (SELECT DISTINCT r, i, t FROM met)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.cross_tokens import TOKENIZERS, align_tokenizers, read_file

    a, b = (read_file(f"{TOKENIZERS}/{name}") for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokenizers(read_table(spark, sf_dir, "documents"), a, b)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.conversation_repair import damaged, repair

    return repair(damaged(read_table(spark, sf_dir, "conversations")))


def _op13_sql() -> str:
    """The least (cost, audit) of each state of the role grammar, row by row; a state is one sortable text."""

    def ext(x: str, cost: str, letters: str, *lines: str) -> str:
        said = "".join(f" || chr(10) || {line}" for line in lines)
        end = f"instr({x}, chr(31))"
        return f"(lpad(CAST(CAST(left({x}, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({x}, 9, {end} - 9) || '{letters}' || substr({x}, {end}){said})"

    def to(role: str, sources: str, before: str, inserted: str) -> list[str]:
        """Ways to end in ``role``: from states that it may follow, or from those where another goes in first."""
        kept, changed, other = "role || ':' || text", f"'{role}:' || text", f"'{inserted}:'"
        on = f"CASE WHEN NOT gone AND initial = '{role[0]}' THEN"
        out = []
        for x in sources:
            out += [f"{on} {ext(x, 'cut', 'K', kept)} END", f"CASE WHEN NOT gone THEN {ext(x, '2 + cut', 'R', changed)} END"]
        for x in before:
            out += [f"{on} {ext(x, '2 + cut', 'IK', other, kept)} END", f"CASE WHEN NOT gone THEN {ext(x, '4 + cut', 'IR', other, changed)} END"]
        return out

    drop = lambda x: ext(x, "3", "D")
    least = lambda *ways: f"least({', '.join(ways)})"
    system = f"CASE WHEN NOT gone AND initial = 's' THEN {ext('n', 'cut', 'K', """role || ':' || text""")} END"
    last = least("n", "p", ext("o", "2", "I", "'assistant:'"), ext("h", "4", "II", "'user:'", "'assistant:'"))
    return rf"""
WITH RECURSIVE named AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
said AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(t.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
         FROM conversations t JOIN named ON t.conv_id IS NOT DISTINCT FROM named.conv_id),
crc AS (SELECT DISTINCT k, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM said
        UNION ALL SELECT k, i + 1, list_reduce([xor(v, CAST(ascii(substr(k, CAST(i + 1 AS BIGINT), 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) FROM crc WHERE i < length(k)),
codes AS (SELECT k, xor(v, 4294967295) % 20 AS code FROM crc WHERE i = length(k)),
damaged AS (SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM said JOIN codes USING (k) WHERE code <> 0),
sorted AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS twice, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM sorted),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN twice THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM again),
rows AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CAST(fault = 'truncated' AS INT) AS cut FROM faults),
parsed AS (SELECT c, CAST(0 AS BIGINT) AS i, '00000000' || chr(31) AS n, CAST(NULL AS VARCHAR) AS h, CAST(NULL AS VARCHAR) AS o, CAST(NULL AS VARCHAR) AS p FROM named
           UNION ALL
           SELECT c, rows.i, {drop('n')}, {least(drop('h'), system)},
                  {least(drop('o'), *to('user', 'nhp', 'o', 'assistant'))},
                  {least(drop('p'), *to('assistant', 'o', 'nhp', 'user'))}
           FROM parsed JOIN rows USING (c) WHERE rows.i = parsed.i + 1),
ended AS (SELECT c, {last} AS best FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i DESC) AS z FROM parsed) WHERE z = 1),
counts AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(left(best, 8) AS BIGINT) AS cost, substr(best, 9, instr(best, chr(31)) - 9) AS audit, sha256(substr(best, instr(best, chr(31)) + 2)) AS repaired_sha256
FROM named JOIN ended USING (c) LEFT JOIN counts USING (c)
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_block_naming_dedup": OP2_SQL, "op3_preference_formatting": OP3_SQL, "op6_parity_sketch_join": OP6_SQL, "op11_winnowing_decontamination": OP11_SQL, "op13_conversation_repair": OP13_SQL}

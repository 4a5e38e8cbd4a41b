"""The registered queries of this subpackage and, where SQL can say the same, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, host_rules, language_id, line_dedup, media, minhash_dedup, packing, quality, sentence_dedup, threshold_search, token_counts, tool_calls, vector_codes
from ._common import ship, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.filter(language_id.fold(docs, 4) != 2), labels.filter(language_id.fold(labels, 4) != 2))
    s = quality.score(docs, model)
    return s.select("doc_id", (language_id.fold(s, 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return media.digests(media.encode_texts(table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.answers(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, words="ascii")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    langs, log_prob = language_id.fit(docs.filter(language_id.fold(docs, 3) != 1))
    got = language_id.identify(docs.select("doc_id", "text"), langs, log_prob)
    return got.select("doc_id", (language_id.fold(got, 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.TURN_SCHEMAS, silent=("context",))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sentence_dedup.drop_repeated_sentences(table(spark, sf_dir, "documents"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _host_sql() -> str:
    rules = host_rules.RULES
    low, high = host_rules.STRENGTHS
    sums = ", ".join(f"count_if({e}) AS k_{r}" for r, e in rules.items())
    total = ", ".join(f"sum(k_{r}) AS s_{r}, sum(CAST(k_{r} AS DOUBLE) * k_{r} / n) AS q_{r}" for r in rules)
    prior = []
    for r in rules:
        p = f"(s_{r} / n)"
        within = f"((q_{r} - n * {p} * {p} - {p} * (1 - {p}) * (h - 1)) / ({p} * (1 - {p}) * (n - nn / n - (h - 1))))"
        weight = f"(CASE WHEN n - nn / n > h - 1 AND {within} > 0 THEN least(greatest((1 - {within}) / {within}, {low}), {high}) ELSE {high} END)"
        known = f"h >= 2 AND s_{r} > 0 AND s_{r} < n"
        prior += [f"CASE WHEN {known} THEN {p} * {weight} ELSE 0.5 END AS a_{r}", f"CASE WHEN {known} THEN (1 - {p}) * {weight} ELSE 0.5 END AS b_{r}"]
    bad = ", ".join(f"CASE WHEN (k_{r} + a_{r}) / (n + a_{r} + b_{r}) > {host_rules.MOST} THEN '{r}' END" for r in rules)
    failed = " OR ".join(f"({rules[r]})" for r in host_rules.BASE)
    return rf"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY 1),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) AS q(k) GROUP BY 1),
m AS (SELECT t.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM t LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
h AS (SELECT source, count(*) AS n, {sums} FROM m WHERE source IS NOT NULL GROUP BY 1),
z AS (SELECT count(*) AS h, CAST(sum(n) AS DOUBLE) AS n, sum(CAST(n AS DOUBLE) * n) AS nn, {total} FROM h),
p AS (SELECT {", ".join(prior)} FROM z),
v AS (SELECT source, concat_ws(',', {bad}) AS host_failures FROM h, p),
j AS (SELECT m.*, {failed} AS base_failed, host_failures FROM m LEFT JOIN v USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, host_failures, NOT base_failed AND coalesce(host_failures, '') = '' AS kept FROM j"""


def _codes_sql() -> str:
    """Lloyd rounds written out one after the other, each assignment over all parts anew."""
    v = vector_codes
    steps = [
        f"e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({v.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, part, v[part * len(v) // {v.PARTS} + 1 : (part + 1) * len(v) // {v.PARTS}] AS v FROM e, range({v.PARTS}) AS r(part))",
        f"b0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, v FROM p QUALIFY entry < {v.ENTRIES})",
    ]
    for r in range(v.ROUNDS + 1):
        d = "CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) AS BIGINT)"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS x FROM (SELECT vec_id, part, entry, {d} AS d FROM p JOIN b{r} b USING (part)) GROUP BY 1, 2)")
        if r < v.ROUNDS:
            steps.append(f"m{r} AS (SELECT part, x.entry AS entry, i, count(*) AS n, CAST(sum(v[i]) AS BIGINT) AS s FROM (SELECT part, x, v, unnest(range(1, len(v) + 1)) AS i FROM a{r} JOIN p USING (vec_id, part)) GROUP BY 1, 2, 3)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(k.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY 1, 2) k ON k.part = b.part AND k.entry = b.entry)")
    steps.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', x.entry), '' ORDER BY part) AS code, CAST(sum(x.d) AS BIGINT) AS error FROM a{v.ROUNDS} GROUP BY 1)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{v.ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM c JOIN e USING (vec_id), h"


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


SQL = {
    "op6_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE t END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.id = e.x),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_tool_calls": r"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, to_json(text) AS jt FROM conversations),
c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'context' ELSE role END AS name, role, text, '{"role":' || coalesce(to_json(role), 'null') || ',"text":' || coalesce(jt, 'null') || '}' AS args FROM t WHERE role IS DISTINCT FROM 'assistant'),
c1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY name NULLS FIRST, args) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM c),
r1 AS (SELECT conv_id, turn, text, jt, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM t WHERE role = 'assistant'),
cf AS (SELECT * FROM c1 WHERE k = 1), rf AS (SELECT * FROM r1 WHERE k = 1),
lv(conv_id, turn, level) AS (SELECT conv_id, turn, 0 FROM cf a WHERE NOT (role IS NOT DISTINCT FROM 'user' AND turn >= 2 AND EXISTS (SELECT 1 FROM cf b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2))
  UNION ALL SELECT a.conv_id, a.turn, lv.level + 1 FROM lv JOIN cf a ON a.conv_id = lv.conv_id AND a.turn = lv.turn + 2 AND a.role = 'user' AND a.turn >= 2),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conversation, CAST(CASE WHEN a.n IS NULL THEN b.turn - 1 ELSE a.turn END AS VARCHAR) AS call_id, a.turn AS call_position, b.turn AS result_position, a.name, a.role, a.text, a.args, b.jt AS content, coalesce(a.n, 0) + coalesce(b.n, 0) AS copies,
    CASE WHEN a.n IS NULL THEN 'orphan' WHEN b.n IS NOT NULL THEN 'linked' WHEN a.name = 'context' THEN 'silent' ELSE 'unanswered' END AS status, a.n IS NOT NULL AS called FROM cf a FULL JOIN rf b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1
  UNION ALL SELECT conv_id, CAST(turn AS VARCHAR), turn, NULL, name, role, text, args, NULL, n, 'conflicting', true FROM (SELECT DISTINCT a.conv_id, a.turn, a.name, a.role, a.text, a.args, a.n FROM c1 a JOIN cf b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE (a.name, a.args) IS DISTINCT FROM (b.name, b.args))
  UNION ALL SELECT conv_id, CAST(turn - 1 AS VARCHAR), NULL, turn, NULL, NULL, NULL, NULL, jt, n, 'conflicting', false FROM (SELECT DISTINCT a.conv_id, a.turn, a.jt, a.n FROM r1 a JOIN rf b ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.text IS DISTINCT FROM b.text)),
v AS (SELECT *, concat_ws('; ', CASE WHEN NOT called THEN '$: no call' WHEN name IS NULL OR name NOT IN ('reply', 'context') THEN '$: unknown tool' WHEN text IS NULL THEN '$.text: type' WHEN name = 'reply' AND text = '' THEN '$.text: minLength' END,
    CASE WHEN status NOT IN ('conflicting', 'orphan') AND role = 'user' AND call_position >= 2 AND NOT EXISTS (SELECT 1 FROM cf b WHERE b.conv_id = j.conversation AND b.turn = j.call_position - 2) THEN 'depends: ' || (call_position - 2) END) AS violations FROM j)
SELECT call_id, conversation, CASE WHEN status IN ('linked', 'silent', 'unanswered') THEN lv.level END AS level, call_position, result_position, status, violations = '' AS valid, violations, copies,
 '{"arguments":' || coalesce(args, 'null') || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name), 'null') || ',"result":' || coalesce(content, 'null') || '}' AS canonical FROM v LEFT JOIN lv ON lv.conv_id = v.conversation AND lv.turn = v.call_position""",
    "op9_decontamination": r"""WITH wi AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '') AS t FROM benchmark),
wd AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '') AS t FROM documents),
gi AS (SELECT DISTINCT item_id, least(5, len(t)) AS w, unnest(list_transform(range(1, len(t) - least(5, len(t)) + 2), lambda i: array_to_string(t[i : i + least(5, len(t)) - 1], ' '))) AS g FROM wi WHERE len(t) > 0),
k AS (SELECT DISTINCT w FROM gi),
gd AS (SELECT DISTINCT doc_id, w, unnest(list_transform(range(1, len(t) - w + 2), lambda i: array_to_string(t[i : i + w - 1], ' '))) AS g FROM wd, k WHERE len(t) >= w),
n AS (SELECT item_id, count(*) AS n FROM gi GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(n.n) AS n_shingles, count(*) / any_value(n.n) AS containment FROM gi JOIN gd USING (w, g) JOIN n USING (item_id) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(n.n)""",
    "op11_host_rules": _host_sql(),
    "op12_threshold_search": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS g FROM documents),
p AS (SELECT doc_id, g, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
df AS (SELECT g, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT item_id, g, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS g FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
  FROM i JOIN p USING (g) JOIN df USING (g) JOIN n USING (doc_id), z GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10""",
    "op13_vector_codes": _codes_sql(),
}


def oracle_sql() -> dict[str, str]:
    """For the queries whose rows SQL can give: the others need a tokenizer, hashes of their own, a fit or a media format."""
    return dict(SQL)

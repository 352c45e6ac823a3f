"""User hooks (family O) and the scalar surface by family (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions import extract as ex
from rolloom.functions import plugins as pl
from rolloom.functions import text as tx
from rolloom.functions import tokens as tk
from rolloom.plans import on_answers as oa
from rolloom.plans.base import query
from rolloom.plans.on_trajectory import _sql_rounds, bits


@query(
    "o01_custom_template",
    """SELECT id, CASE WHEN coalesce(domain, 'math') = 'math' THEN concat('[', source, '] ', input) WHEN domain = 'code' THEN concat('code: ', input) ELSE input END AS prompt FROM f_mix""",
)
def custom_template(v):
    hooks = pl.Plugins()
    hooks.register_template("math", lambda row: F.concat(F.lit("["), row["source"], F.lit("] "), row["input"]))
    hooks.register_template("code", lambda row: F.concat(F.lit("code: "), row["input"]))
    rows = v.f_mix.withColumn("template", F.coalesce("domain", F.lit("math")))
    return rows.select("id", hooks.prompt(rows, "template", F.col("input")).alias("prompt"))


@query(
    "o02_custom_scorer",
    f"""WITH a AS (SELECT resp_id, gold, resp_id % 3 AS k, CASE WHEN resp_id % 3 = 0 THEN {oa.SQL_PHRASE} ELSE {oa.sql_mc_letter('response')} END AS pred FROM f_resp)
      SELECT resp_id, CASE k WHEN 0 THEN pred = gold WHEN 1 THEN length(pred) = 1 AND ascii(pred) >= ascii(gold) ELSE false END AS correct FROM a""",
)
def custom_scorer(v):
    """A Column checker, a Python checker that may raise, and no checker."""
    hooks = pl.Plugins()
    hooks.register_extractor("phrase", lambda row: ex.stated_phrase(row["response"]))
    hooks.register_checker("phrase", lambda p, g: p == g)
    hooks.register_checker("order", pl.python_checker(lambda p, g: ord(p) >= ord(g)))
    k = F.col("resp_id") % 3
    rows = v.f_resp.withColumn("hook", F.when(k == 0, "phrase").when(k == 1, "order").otherwise("none"))
    rows = rows.select("resp_id", "gold", "hook", hooks.answer(rows, "hook", ex.mc_letter(F.col("response"))).alias("pred"))
    return rows.select("resp_id", hooks.verdict(F.col("hook"), F.col("pred"), F.col("gold")).alias("correct"))


@query(
    "o03_batch_scoring",
    "SELECT user_id, event_id, event_id % 11 <> 0 AND value > 10 AS correct FROM events",
)
def batch_scoring(v):
    """Whole rows judged on the executors; a failing row is wrong."""
    rows = v.table("events").select("user_id", "event_id", "value")
    return pl.scored_in_batches(rows, lambda r: 1 // (r["event_id"] % 11) >= 0 and r["value"] > 10).drop("value")


@query(
    "o03_frame_scoring",
    "SELECT user_id, event_id, value > 10 AND event_type <> 'error' AS correct FROM events",
)
def frame_scoring(v):
    """One call for each Arrow batch, by a scorer of whole frames."""
    rows = v.table("events").select("user_id", "event_id", "event_type", "value")
    scored = pl.scored_by_frames(rows, lambda f: (f["value"] > 10) & (f["event_type"] != "error"))
    return scored.select("user_id", "event_id", "correct")


@query(
    "o04_round_table_function",
    f"""WITH {_sql_rounds(1)} SELECT x.resp_id, x.round, string_agg(CASE WHEN r = round THEN '1' ELSE '0' END, '' ORDER BY pos) AS target,
        string_agg(CASE WHEN r >= round THEN '1' ELSE '0' END, '' ORDER BY pos) AS noise FROM x JOIN r ON r.resp_id = x.resp_id GROUP BY 1, 2""",
)
def round_table_function(v):
    pl.register_table_functions(v.spark)
    v.f_step.createOrReplaceTempView("step_rows")
    rows = v.spark.sql("SELECT s.resp_id, e.* FROM step_rows s, LATERAL expand_rounds(s.step_map, 1, 4) e")
    return rows.select("resp_id", "round", bits("target").alias("target"), bits("noise").alias("noise"))


@query(
    "o05_tokenizer",
    """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS INT) AS n_words, octet_length(encode(text)) AS n_bytes FROM documents""",
)
def tokenizer(v):
    """The default tokenizer, and a byte tokenizer plugged in."""
    as_bytes = tk.tokenizer(lambda text: list(text.encode("utf-8")))
    return v.documents().select(
        "doc_id",
        F.size(tk.split_words(F.col("text"))).alias("n_words"),
        F.size(as_bytes(F.col("text"))).cast("bigint").alias("n_bytes"),
    )


S = tx.SPACE


@query(
    "l01_string_surface",
    f"""SELECT doc_id, {oa.sql_strip('text')} AS stripped, list_last(string_split(text, ' ')) AS last_word, string_split(text, chr(10))[1] AS first_line,
        CASE WHEN length(text) <= 80 THEN text ELSE concat(substr(text, 1, 40), '...(truncated) ...', right(text, 40)) END AS cut, starts_with(text, 'T') AS t FROM documents""",
)
def string_surface(v):
    c = F.col("text")
    return v.documents().select(
        "doc_id",
        tx.strip(c).alias("stripped"),
        tx.after_last(c, " ").alias("last_word"),
        tx.before(c, "\n").alias("first_line"),
        tx.middle_truncate(c, 80).alias("cut"),
        F.startswith(c, F.lit("T")).alias("t"),
    )


@query(
    "l02_math_surface",
    """SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 3) AS BIGINT) AS up, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS even,
       greatest(5.0, least(20.0, l_quantity)) AS clamped, round(exp(-l_discount), 9) AS e, round(ln(1 + l_quantity), 9) AS l, abs(l_tax - l_discount) <= 1e-8 + 1e-5 * abs(l_discount) AS close FROM lineitem""",
)
def math_surface(v):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.ceil(q / 3).alias("up"),
        F.bround(q / 2, 0).cast("bigint").alias("even"),
        F.greatest(F.lit(5.0), F.least(F.lit(20.0), q)).alias("clamped"),
        F.round(F.exp(-d), 9).alias("e"),
        F.round(F.ln(1 + q), 9).alias("l"),
        (F.abs(t - d) <= F.lit(1e-8) + 1e-5 * F.abs(d)).alias("close"),
    )


@query(
    "l03_month_prefix",
    "SELECT id, substr(contest_date, 1, 7) AS month, substr(contest_date, 1, 7) BETWEEN '1995-10' AND '1996-02' AS inside FROM f_date",
)
def month_prefix(v):
    month = F.substring("contest_date", 1, 7)
    return v.f_date.select("id", month.alias("month"), month.between("1995-10", "1996-02").alias("inside"))


@query(
    "l04_array_surface",
    """SELECT resp_id, CAST(len(list_distinct(step_map)) AS INT) AS kinds, list_max(step_map) AS top, array_to_string(step_map[2:4], ',') AS part,
       list_sum(step_map)::BIGINT AS total, len(list_filter(step_map, lambda s: s > 3)) > 0 AS any_high, len(list_filter(step_map, lambda s: s < 0)) = 0 AS none_low FROM f_step""",
)
def array_surface(v):
    s = F.col("step_map")
    return v.f_step.select(
        "resp_id",
        F.size(F.array_distinct(s)).alias("kinds"),
        F.array_max(s).alias("top"),
        F.array_join(F.slice(s, 2, 3), ",").alias("part"),
        F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.exists(s, lambda x: x > 3).alias("any_high"),
        F.forall(s, lambda x: x >= 0).alias("none_low"),
    )


@query(
    "l05_map_surface",
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing'), 'default') AS other FROM events""",
)
def map_surface(v):
    fields = F.from_json("props", "map<string,string>")
    return v.table("events").select(
        "event_id",
        F.coalesce(F.try_element_at(fields, F.lit("k")), F.lit("none")).alias("k"),
        F.coalesce(F.try_element_at(fields, F.lit("missing")), F.lit("default")).alias("other"),
    )


@query(
    "l06_json_surface",
    """SELECT id, CAST(json_extract(public_tests, '$[0].input') AS VARCHAR) AS raw, json_array_length(private_tests)::INT AS n, json_valid(concat(metadata, 'x')) AS broken FROM f_date""",
)
def json_surface(v):
    broken = tx.valid_json(F.concat("metadata", F.lit("x"))).isNotNull()
    first = F.try_variant_get(F.try_parse_json("public_tests"), "$[0].input", "variant")
    return v.f_date.select(
        "id", F.to_json(first).alias("raw"), F.json_array_length("private_tests").alias("n"), broken.alias("broken")
    )

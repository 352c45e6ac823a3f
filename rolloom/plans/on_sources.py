"""Sources and sinks (family A). Files go to the shared work folder."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rolloom.plans.base import query
from rolloom.plans.on_preparation import sql_text
from rolloom.plans.on_prompts import HEADER, SQL_PREFILLED, sql_fill, sql_turn
from rolloom.operators import prompts as pm
from rolloom.session import work_dir
from rolloom.sources import arrays
from rolloom.sources import config as cf
from rolloom.sources import files as fs
from rolloom.sources import registry as rg

_DOC = "doc_id bigint, text string, lang string"


@query("a01_read_json_arrays", "SELECT doc_id, text, lang FROM documents")
def json_arrays(v):
    path = work_dir(v.spark, "arrays")
    record = F.to_json(F.struct("doc_id", "text", "lang"))
    chunks = v.table("documents").groupBy(F.floor(F.col("doc_id") / 512).alias("chunk")).agg(F.collect_list(record).alias("r"))
    arrays = chunks.select("chunk", F.concat(F.lit("["), F.array_join("r", ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("chunk").text(path)
    return fs.read_json_arrays(v.spark, path, _DOC).select("doc_id", "text", "lang")


def _arrays_of(docs, key):
    """Lines of one array for each key, its brackets on the first and last record.

    The brackets come from the order of the rows themselves: as rows of their own
    they could be written by another task than the records.
    """
    numbered = docs.select("doc_id", "text", "lang", key.alias("key"))
    order = Window.partitionBy("key").orderBy("doc_id")
    n, last = F.row_number().over(order), F.lead(F.lit(True)).over(order).isNull()
    placed = numbered.select("key", F.to_json(F.struct("doc_id", "text", "lang")).alias("record"), n.alias("n"), last.alias("last"))
    value = F.concat(F.when(F.col("n") == 1, "[").otherwise(","), F.col("record"), F.when(F.col("last"), "]").otherwise(""))
    return placed.select("key", "n", value.alias("value")).sortWithinPartitions("key", "n").select("key", "value")


@query("a01_large_arrays", "SELECT doc_id, text, lang FROM documents")
def large_arrays(v):
    """One array for each language, a few large files, converted to Parquet."""
    path, table = work_dir(v.spark, "array"), work_dir(v.spark, "converted")
    _arrays_of(v.table("documents"), F.coalesce("lang", F.lit(""))).write.partitionBy("key").text(path)
    return arrays.to_parquet(v.spark, path, _DOC, table)


@query(
    "a02_read_json_lines",
    """SELECT CASE WHEN ok THEN doc_id END AS doc_id, CASE WHEN ok THEN text END AS text, CASE WHEN ok THEN lang END AS lang,
        CASE WHEN NOT ok THEN 20 END::INT AS bad_length FROM (SELECT *, doc_id % 10 <> 3 AS ok FROM documents) d""",
)
def json_lines(v):
    path = work_dir(v.spark, "lines")
    record = F.to_json(F.struct("doc_id", "text", "lang"))
    broken = F.when(F.col("doc_id") % 10 == 3, F.substring(record, 1, 20)).otherwise(record)
    # a blank line after every record
    v.table("documents").select(F.explode(F.array(broken, F.lit(""), F.lit("  "))).alias("value")).write.text(path)
    rows = fs.read_json_lines(v.spark, path, _DOC, keep_bad=True)
    good = F.col(fs.CORRUPT).isNull()
    return rows.select(*[F.when(good, F.col(c)).alias(c) for c in ("doc_id", "text", "lang")], F.length(fs.CORRUPT).alias("bad_length"))


@query("a03_read_parquet_mix", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def parquet_mix(v):
    rows = fs.read_parquet(v.spark, f"{v.folder}/documents.parquet")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_NAMES = ["GSM8K", "MMLU", "HumanEval", "Hybrid_train", "TriviaQA", "LCB_v6", "LiveMathBench_Hard", "IFEval"]


def _named(v, key):
    return F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col(key) % 8 + 1).cast("int"))


def _sql_case(field):
    parts = " ".join(
        f"WHEN {i} THEN {sql_text(value) if (value := getattr(rg.DATASETS[n], field)) is not None else 'NULL'}"
        for i, n in enumerate(_NAMES)
    )
    return f"CASE CAST(doc_id % 8 AS INT) {parts} END"


@query(
    "a04_registry_lookup",
    f"SELECT doc_id, concat('/data/', {_sql_case('path')}) AS path, {_sql_case('domain')} AS dataset_domain FROM documents",
)
def registry_lookup(v):
    rows = v.table("documents").select("doc_id", _named(v, "doc_id").alias("dataset"))
    return rg.located(rows, "dataset", "/data").select("doc_id", "path", "dataset_domain")


_SQL_LANGUAGE = f"CASE WHEN subdivision = 'lang_cn' THEN {sql_fill(pm.MATH_CN, 'input')} ELSE {sql_fill(pm.MATH_EN, 'input')} END"
_SQL_DOMAIN = f"""CASE coalesce(domain, 'math') WHEN 'math' THEN {sql_fill(pm.STEP_BY_STEP, 'input')}
    WHEN 'science' THEN {sql_fill(pm.CHOICE_ONLY, 'input')} ELSE input END"""
_SQL_TRIVIA = f"{sql_turn('user', sql_text(pm.TRIVIA_SHOT[0]))}, {sql_turn('assistant', sql_text(pm.TRIVIA_SHOT[1]))}"
# The prompt of each dataset in the order of the names above.
_CHATS = [
    f"concat({sql_turn('user', sql_fill(pm.STEP_BY_STEP, 'input'))}, {HEADER})",
    f"concat({sql_turn('user', sql_fill(pm.CHOICE_ONLY, 'ref'))}, {HEADER})",
    SQL_PREFILLED,
    f"concat({sql_turn('user', _SQL_DOMAIN)}, {HEADER})",
    f"""concat({_SQL_TRIVIA}, {sql_turn('user', "concat('Q: ', input)")}, {HEADER})""",
    f"concat({sql_turn('system', sql_text(pm.CODE_SYSTEM))}, {sql_turn('user', 'input')}, {HEADER})",
    f"concat({sql_turn('user', _SQL_LANGUAGE)}, {HEADER})",
    f"concat({sql_turn('user', 'input')}, {HEADER})",
]


@query(
    "a04_registry_prompts",
    f"""SELECT id, CASE CAST(id % 8 AS INT) {' '.join(f'WHEN {k} THEN {e}' for k, e in enumerate(_CHATS))} END AS prompt
        FROM (SELECT *, regexp_replace(input, '\\(([A-J])\\)[\\t-\\r\\x1c- \\x{{85}}\\p{{Z}}]*', '\\1. ', 'g') AS ref FROM f_mix) x""",
)
def registry_prompts(v):
    rows = v.f_mix.select("*", _named(v, "id").alias("dataset"))
    prompt = rg.chat(F.col("dataset"), F.col("domain"), F.col("subdivision"), F.col("input"))
    return rows.select("id", prompt.alias("prompt"))


@query("a05_write_dataset", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def write_dataset(v):
    path = work_dir(v.spark, "dataset")
    rows = v.table("documents").select("doc_id", "text", "lang", "source")
    fs.write_dataset(rows, path, ["lang"])
    back = v.spark.read.parquet(path)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "a06_append_results",
    "SELECT user_id, count(*) * 2 AS lines, round(max(value), 9) AS best FROM events GROUP BY user_id",
)
def append_results(v):
    path = work_dir(v.spark, "results")
    rows = v.table("events").select("user_id", "value")
    for _ in range(2):
        fs.append_results(rows, path)
    back = v.spark.read.parquet(path)
    return back.groupBy("user_id").agg(F.count("*").alias("lines"), F.round(F.max("value"), 9).alias("best"))


@query(
    "a07_export_solutions",
    "SELECT sample_id AS task_id, response AS solution FROM f_roll WHERE sample_id % 7 <> 2",
)
def export_solutions(v):
    path = work_dir(v.spark, "solutions")
    from rolloom.operators.reshape import regroup

    nested = regroup(v.f_roll, "sample_id", "resp_idx", ["response"])
    task = F.when(F.col("sample_id") % 7 != 2, F.col("sample_id"))
    fs.solution_lines(nested.select(task.alias("task_id"), F.col("response").alias("full_output"))).write.json(path)
    return fs.read_json_lines(v.spark, path, "task_id bigint, solution string")


@query("a08_merge_chunks", "SELECT conv_id, turn, response, chunk_id FROM f_outputs")
def merge_chunks(v):
    """Outputs in a folder for each chunk, against the chunks of the requests."""
    path = work_dir(v.spark, "chunks")
    v.f_outputs.write.partitionBy("chunk_id").parquet(path)
    chunks = v.spark.read.schema(v.f_outputs.schema).parquet(path)
    asked = v.f_requests.select((F.col("conv_id") % 8).cast("int").alias("chunk_id"))
    return fs.merged_chunks(chunks, asked, ["chunk_id", "conv_id", "turn"])


@query(
    "a09_dataset_verification",
    f"""WITH r AS (SELECT unnest([{', '.join(sql_text(n) for n in rg.DATASETS)}]) AS dataset, unnest([{', '.join(str(d.required).lower() for d in rg.DATASETS.values())}]) AS required),
      c AS (SELECT CASE CAST(doc_id % 8 AS INT) {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))} END AS dataset, count(*) AS n,
        count(*) FILTER (WHERE n_chars < 100 OR doc_id % 24 = 5) AS n_bad FROM documents GROUP BY 1)
    SELECT r.dataset, r.required, coalesce(c.n, 0) AS n, coalesce(c.n_bad, 0) AS n_bad, CASE WHEN c.n IS NULL AND r.required THEN 'missing' WHEN c.n IS NULL THEN 'absent'
      WHEN c.n_bad > 0 THEN 'unreadable rows' ELSE 'ok' END AS status FROM r LEFT JOIN c ON c.dataset = r.dataset""",
)
def dataset_verification(v):
    rows = v.table("documents").select(
        _named(v, "doc_id").alias("dataset"), ((F.col("n_chars") < 100) | (F.col("doc_id") % 24 == 5)).alias("bad")
    )
    return rg.verification(rg.registry_frame(v.spark), rows, "dataset", "bad")


@query(
    "a10_run_catalogue",
    "SELECT CAST(regexp_extract(run, '([0-9]+)$', 1) AS INT) AS run, CASE WHEN mtime % 1100 <> 0 THEN current_epoch END AS step FROM f_runs",
)
def run_catalogue(v):
    """Metadata documents, some truncated, some without a step."""
    doc = F.to_json(F.struct("current_epoch", F.lit("best").alias("last_save_name")))
    text = F.when(F.col("mtime") % 1100 == 0, F.substring(doc, 1, 9)).otherwise(doc)
    run = F.regexp_extract("run", "([0-9]+)$", 1).cast("int")
    docs = v.f_runs.select(run.alias("run"), text.alias("doc"))
    return fs.run_steps(docs, "doc").select("run", F.col("meta.current_epoch").alias("step"))


_SQL_DOCS = """SELECT o_orderkey AS run, unnest(['model.name', 'model.layers.0', 'model.layers.1.width', 'seed', 'note', 'debug']) AS key,
    unnest([o_orderpriority, '1', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), NULL, 'true']) AS value FROM orders"""


@query("a11_flatten_config", _SQL_DOCS)
def flatten_config(v):
    layer = F.struct(F.col("o_custkey").alias("width"))
    doc = F.concat(
        F.lit('{"model":{"name":"'), F.col("o_orderpriority"), F.lit('","layers":[1,'), F.to_json(layer),
        F.lit(']},"seed":'), F.col("o_orderkey").cast("string"), F.lit(',"note":null,"debug":true}'),
    )
    docs = v.table("orders").select(F.col("o_orderkey").alias("run"), doc.alias("doc"))
    return cf.flattened(docs, "run", "doc")


@query(
    "a12_config_layering",
    """WITH l AS (SELECT user_id AS run, 1 AS priority, concat('k', CAST(event_id AS VARCHAR)) AS key, json_extract_string(props, '$.k') AS value FROM events
        UNION ALL SELECT user_id, 2, concat('k', CAST(event_id AS VARCHAR)), 'cli' FROM events WHERE user_id % 3 = 0 AND event_type = 'error')
       SELECT run, key, arg_max(value, priority) AS value FROM l GROUP BY run, key""",
)
def config_layering(v):
    events = v.table("events").withColumn("key", F.concat(F.lit("k"), F.col("event_id").cast("string")))
    base = events.select(
        F.col("user_id").alias("run"), F.lit(1).alias("priority"), "key", F.get_json_object("props", "$.k").alias("value")
    )
    over = events.filter("user_id % 3 = 0 AND event_type = 'error'").select(
        F.col("user_id").alias("run"), F.lit(2).alias("priority"), "key", F.lit("cli").alias("value")
    )
    return cf.layered(base.unionByName(over))

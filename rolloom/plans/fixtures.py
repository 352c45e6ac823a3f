"""Views over the given tables in the shapes the operators consume.

One SQL text serves Spark and the checking engine; where the engines name a
function differently, the text is a pair. Backslash, newline and backtick are
written as ``chr(92)``, ``chr(10)`` and ``chr(96)`` because the engines treat
escapes in literals differently. Every view covers its tables whole.
"""

from __future__ import annotations

FENCE = "repeat(chr(96), 3)"

# Tail of a response, by form of the answer; the whole document precedes it.
_RESP_TAIL = f"""
  CASE CAST(resp_id % 10 AS INT)
    WHEN 0 THEN concat('So ', chr(92), 'boxed{{', chr(92), 'text{{', pick, '}}}} done')
    WHEN 1 THEN concat('**Answer:** ', pick)
    WHEN 2 THEN concat('the correct answer is:', chr(10), chr(10), '**', pick, '**')
    WHEN 3 THEN concat('Either B or C, so ', pick)
    WHEN 4 THEN concat('The answer is 1,', CAST(100 + resp_id % 7 AS STRING), '.')
    WHEN 6 THEN concat('first ', chr(92), 'boxed{{1}} last ', chr(92), 'boxed{{', chr(92), 'frac{{',
                       CAST(resp_id % 5 AS STRING), '}}{{2}}}} rest')
    WHEN 7 THEN concat({FENCE}, 'python', chr(10), 'def f(x):', chr(10), '    return x', chr(10), {FENCE},
                       chr(10), 'use:', chr(10), {FENCE}, 'python', chr(10), 'print(f(1))', chr(10), {FENCE},
                       chr(10), 'assert f(1) == ', CAST(resp_id AS STRING))
    WHEN 8 THEN concat('So the answer is (', pick, '). End.', chr(10), 'bye <|im_end|>  ')
    ELSE concat('A: The Town of ', pick, '-ville, probably.') END"""

f_resp = f"""
SELECT resp_id, sample_id, resp_idx, gold, pick,
  CASE WHEN resp_id % 10 = 5 THEN '' WHEN resp_id % 20 = 9 THEN {_RESP_TAIL}
       ELSE concat(text, chr(10), {_RESP_TAIL}) END AS response,
  CASE CAST(resp_id % 6 AS INT) WHEN 0 THEN 'math' WHEN 1 THEN 'science' WHEN 2 THEN 'code'
    WHEN 3 THEN 'triviaqa' WHEN 4 THEN 'livebench' END AS domain,
  CASE WHEN resp_id % 14 = 0 THEN 'phrase' WHEN resp_id % 22 = 0 THEN 'number' END AS override_name,
  CASE WHEN resp_id % 3 = 0 THEN 'plain' ELSE 'strict' END AS scorer,
  CASE WHEN resp_id % 4 = 0 THEN 'ABCD' WHEN resp_id % 4 = 1 THEN 'ABCDE' END AS letters,
  CASE WHEN resp_id % 10 = 7 THEN 'f' WHEN resp_id % 10 = 3 THEN 'g' END AS fn_name
FROM (SELECT doc_id AS resp_id, text, CAST(floor(doc_id / 4) AS BIGINT) AS sample_id, CAST(doc_id % 4 AS INT) AS resp_idx,
        chr(CAST(65 + floor(doc_id / 4) % 4 AS INT)) AS gold, chr(CAST(65 + (doc_id * 7) % 5 AS INT)) AS pick
      FROM documents) x
"""

f_roll = """
SELECT CAST(floor(d.doc_id / 4) AS BIGINT) AS sample_id, CAST(d.doc_id % 4 AS INT) AS resp_idx,
  CASE CAST(floor(d.doc_id / 4) % 5 AS INT) WHEN 0 THEN 'math' WHEN 1 THEN 'science' WHEN 2 THEN 'code'
    WHEN 3 THEN 'chat' ELSE NULL END AS domain,
  CASE WHEN d.doc_id % 3 = 0 THEN d.source END AS category, d.lang AS subdivision,
  d.n_chars AS n_tokens, coalesce(l.quality, 0) = 1 AS correct, l.doc_id IS NOT NULL AS labelled,
  d.text AS response
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

f_mix = """
SELECT doc_id AS id, domain, source,
  CASE domain WHEN 'math' THEN concat('Please reason step by step, and put your final answer within ', chr(92), 'boxed{}.', chr(10), body)
    WHEN 'science' THEN concat('Please show your choice in the answer field with only the choice letter, e.g., "answer": "C".', chr(10), body)
    WHEN 'code' THEN CASE WHEN doc_id % 2 = 0 THEN concat('You are an expert python programmer.', chr(10), '# Your code here', chr(10), repeat(chr(96), 3), chr(10), chr(10), body)
                     ELSE concat('Preamble line.', chr(10), chr(10), body) END
    ELSE body END AS input,
  CASE WHEN domain = 'code' THEN '["assert f(1) == 2"]' WHEN domain = 'chat' THEN '  ' END AS tests,
  CASE WHEN domain = 'chat' THEN NULL ELSE concat(source, ': ', CAST(doc_id % 97 AS STRING)) END AS answer,
  concat('lang_', CASE WHEN doc_id % 2 = 0 THEN 'cn' ELSE 'en' END) AS subdivision
FROM (SELECT doc_id, source, text AS body,
        CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'math' WHEN 1 THEN 'science' WHEN 2 THEN 'code' WHEN 3 THEN 'chat' END AS domain
      FROM documents) x
"""

f_tests = """
SELECT p_partkey AS sample_id, CASE WHEN p_partkey % 2 = 0 THEN 'stdio' WHEN p_partkey % 3 = 0 THEN 'function' END AS test_method,
  CASE WHEN p_partkey % 4 = 0 THEN concat('f', CAST(p_size AS STRING)) WHEN p_partkey % 4 = 1 THEN '' END AS fn_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'main' END AS entry_point, p_name AS question,
  concat('def f', CAST(p_size AS STRING), '(x):') AS prefix,
  CASE CAST(p_partkey % 9 AS INT)
    WHEN 0 THEN concat('{"type":"pytest","test_code":"def test_a(): pass","fn_name":"f', CAST(p_size AS STRING), '"}')
    WHEN 1 THEN '{"type":"stdio","cases":[{"input":"1","output":"2"}]}'
    WHEN 2 THEN '{"type":"fn_call","fn_name":"g","cases":[{"args":[1],"expected":[2]}]}'
    WHEN 3 THEN '{"type":"fn_call","fn_name":"g","cases":[{"args":"raw","expected":[2]}]}'
    WHEN 4 THEN '["assert f(1) == 2"]' WHEN 5 THEN 'N/A'
    WHEN 6 THEN concat('[', chr(39), 'assert f(1) == 2', chr(39), ']')
    WHEN 7 THEN '{"type":"fn_call","fn_name":"g","cases":[]}' END AS tests_json
FROM part
"""

f_cf = """
SELECT p_partkey AS id, p_name AS title,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat('  Compute $$$', p_brand, '$$$. ') END AS description,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('One integer', chr(13), chr(10)) END AS input_format,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('The $$$', p_type, '$$$ value') END AS output_format,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(CAST(p_size AS STRING), chr(13), chr(10)) END AS ex_input,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(p_brand, chr(13), ' ') END AS ex_output,
  CASE WHEN p_partkey % 7 = 0 THEN ' see $$$n$$$ ' END AS note,
  CASE WHEN p_partkey % 13 = 0 THEN 'file' ELSE 'stdio' END AS input_mode, p_partkey % 17 <> 0 AS executable,
  CASE WHEN p_partkey % 19 = 0 THEN 'dialog' END AS interaction_format, CASE WHEN p_partkey % 23 = 0 THEN 'checker' END AS generated_checker,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 0.0e0 ELSE CAST(p_size AS DOUBLE) / 10e0 END AS time_limit,
  800 + p_size * 10 AS rating, split(p_type, ' ') AS tags,
  CASE WHEN p_partkey % 2 = 0 THEN 'test' ELSE 'train' END AS split
FROM part
"""

f_cf_tests = """
SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS ord, concat(CAST(l_suppkey AS STRING), chr(13), chr(10)) AS input,
  CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE concat(CAST(l_linenumber AS STRING), chr(13)) END AS output
FROM lineitem WHERE l_partkey % 31 <> 0
"""

f_date = """
SELECT o_orderkey AS id, o_orderpriority AS difficulty,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('def solve_', CAST(o_custkey % 9 AS STRING), '(x):') END AS starter_code,
  concat('Sum order ', CAST(o_custkey AS STRING)) AS content,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS contest_date,
  concat('[{"input":"', CAST(o_custkey AS STRING), '","output":"', o_orderstatus, '"}]') AS public_tests,
  concat('[{"input":"x","output":"', CAST(o_orderkey AS STRING), '"},{"input":"y","output":"z"}]') AS private_tests,
  CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE concat('{"func_name":"solve_', CAST(o_custkey % 9 AS STRING), '"}') END AS metadata
FROM orders
"""

f_windows = """
SELECT 'w5' AS name, '1995-10' AS lo, '1996-02' AS hi UNION ALL SELECT 'w6', '1995-08', '1996-05'
"""

f_verd = """
SELECT user_id AS sample_id, CAST(event_id % 10 AS INT) AS resp_idx, CAST(floor(event_id / 10) AS BIGINT) AS test_idx,
  event_type <> 'error' AS passed, CASE WHEN event_type = 'error' THEN CAST(-1 - event_id % 4 AS INT) END AS error_code,
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'siteA' WHEN 1 THEN 'siteB' WHEN 2 THEN 'siteC' END AS platform,
  concat(' ', CAST(event_id AS STRING), CASE WHEN event_id % 2 = 0 THEN '  ok' ELSE ' ok' END, chr(10)) AS output,
  concat(CAST(event_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS STRING), ' ok') AS expected,
  props AS inputs, value AS score,
  CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN concat('line ', CAST(event_id % 40 AS STRING), ': recorded') END AS error
FROM events
"""

f_step = (
    """
SELECT doc_id AS resp_id, transform(sequence(0, CAST(7 + doc_id % 9 AS INT)), p -> CAST((doc_id * 31 + p * p) % 5 AS INT)) AS step_map,
  CASE WHEN doc_id % 6 = 0 THEN 'teacher' WHEN doc_id % 2 = 0 THEN 'student' END AS source
FROM documents
""",
    """
SELECT doc_id AS resp_id, list_transform(range(0, 8 + doc_id % 9), lambda p: CAST((doc_id * 31 + p * p) % 5 AS INT)) AS step_map,
  CASE WHEN doc_id % 6 = 0 THEN 'teacher' WHEN doc_id % 2 = 0 THEN 'student' END AS source
FROM documents
""",
)

_TOKEN = "CASE WHEN p < doc_id % 4 THEN 0 WHEN p > 12 + doc_id % 5 THEN 0 ELSE (doc_id * 13 + p * 7) % 50 END"
f_tok = (
    f"SELECT doc_id AS resp_id, 6 AS prompt_len, transform(sequence(0, 19), p -> CAST({_TOKEN} AS INT)) AS tokens FROM documents",
    f"SELECT doc_id AS resp_id, 6 AS prompt_len, list_transform(range(0, 20), lambda p: CAST({_TOKEN} AS INT)) AS tokens FROM documents",
)

f_lp = (
    """
SELECT CAST(label AS BIGINT) AS seq, vec_id AS pos, token_id, CAST(pair.t AS DOUBLE) AS t_logit, CAST(pair.s AS DOUBLE) AS s_logit
FROM (SELECT e.label, e.vec_id, posexplode(transform(e.embedding, (x, i) -> struct(x AS t, s.embedding[i] AS s))) AS (token_id, pair)
      FROM (SELECT *, CASE WHEN vec_id = (SELECT max(vec_id) FROM embeddings) THEN (SELECT min(vec_id) FROM embeddings)
              ELSE vec_id + 1 END AS next_id FROM embeddings) e JOIN embeddings s ON s.vec_id = e.next_id) x
""",
    """
SELECT CAST(e.label AS BIGINT) AS seq, e.vec_id AS pos, CAST(g.i - 1 AS INT) AS token_id,
  CAST(e.embedding[g.i] AS DOUBLE) AS t_logit, CAST(s.embedding[g.i] AS DOUBLE) AS s_logit
FROM (SELECT *, CASE WHEN vec_id = (SELECT max(vec_id) FROM embeddings) THEN (SELECT min(vec_id) FROM embeddings)
        ELSE vec_id + 1 END AS next_id FROM embeddings) e JOIN embeddings s ON s.vec_id = e.next_id, LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) g
""",
)

f_requests = """
SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'
"""

f_outputs = """
SELECT conv_id, turn - 1 AS turn, text AS response, CAST(conv_id % 8 AS INT) AS chunk_id
FROM conversations WHERE role = 'assistant'
"""

f_shot = """
SELECT CAST(item_id % 5 AS INT) AS subject, item_id AS rank, text AS q, chr(CAST(65 + item_id % 4 AS INT)) AS gold FROM benchmark
"""

f_grid = """
SELECT CAST(floor(c_custkey / 6) AS BIGINT) AS puzzle, CAST(floor((c_custkey % 6) / 2) + 1 AS INT) AS house,
  CASE WHEN c_custkey % 2 = 0 THEN 'Phone Model' ELSE 'Color' END AS gold_attr,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'the phone-model' ELSE 'phone_model' END ELSE 'COLOR' END AS pred_attr,
  c_mktsegment AS gold_val, CASE WHEN floor(c_custkey / 6) % 4 = 0 AND c_custkey % 6 = 3 THEN 'other' ELSE concat(' ', lower(c_mktsegment), ' ') END AS pred_val,
  c_custkey AS ord
FROM customer
"""

# Three lines per customer: a header, its result line, and a later result
# line that no header announces; every seventh header has no result.
f_log = """
SELECT CAST(floor(c_custkey / 500) AS INT) AS shard, c_custkey * 3 AS line_no,
  concat('  Dataset: set_', CAST(c_custkey AS STRING), '  (max_token=4096, is_code=False)') AS line FROM customer
UNION ALL
SELECT CAST(floor(c_custkey / 500) AS INT), c_custkey * 3 + 1,
  concat('train step: ', CAST(1 + c_custkey % 3 AS STRING), '  block_size: 4  acc: 0.', CAST(1000 + c_custkey % 8999 AS STRING),
  '  avg length: ', CAST(40 + c_custkey % 60 AS STRING), '.5  avg tok/step: 1.', CAST(100 + c_custkey % 899 AS STRING), '  [scorable: 9/10]')
FROM customer WHERE c_custkey % 7 <> 0
UNION ALL
SELECT CAST(floor(c_custkey / 500) AS INT), c_custkey * 3 + 2,
  concat('train step: 1  block_size: 4  acc: 0.', CAST(2000 + c_custkey % 7999 AS STRING), '  avg length: 50.0  avg tok/step: 1.000  [scorable: 9/10]')
FROM customer WHERE c_mktsegment = 'BUILDING'
"""

f_runs = """
SELECT s_name AS run, s_suppkey * 100 AS mtime, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 40 AS INT) END AS current_epoch,
  s_suppkey % 5 <> 0 AS has_config, s_suppkey % 3 <> 0 AS has_weights, s_suppkey % 6 = 0 AS has_adapter, CAST(s_nationkey AS INT) AS grp
FROM supplier
"""

f_ledg = """
SELECT event_type AS run, CAST(floor(event_id / 50) AS INT) AS step, CAST(event_id % 4 AS INT) AS worker, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(event_id % 97) AS BIGINT) AS rollout_tokens, CAST(sum(event_id % 53) AS BIGINT) AS loss_tokens, CAST(sum(user_id % 8) AS BIGINT) AS busy
FROM events GROUP BY 1, 2, 3
"""

FIXTURES = {
    name: value if isinstance(value, tuple) else (value, value)
    for name, value in list(globals().items())
    if name.startswith("f_")
}

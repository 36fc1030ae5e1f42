"""DuckDB SQL for the derived fixture views (mirror of ``fixtures``).

Each view is a CTE body over the driver's pre-registered tables.  ``with_views``
assembles the CTEs a query needs (dependencies first) in front of its body.
"""

from __future__ import annotations

from gradebook.plans.fixtures import CATEGORY_CYCLE, MC_RUNS, STOP_MARKER


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


CATS = _list(CATEGORY_CYCLE)

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("raw_qa", [], """
SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS instruction,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS input,
       source AS output, lang AS ops_field, source AS task_type, doc_id AS seq
FROM documents""")

view("questions", [], f"""
SELECT conv_id AS question_id,
       {CATS}[conv_id % 9 + 1] AS category,
       'f' || CAST(conv_id % 5 AS VARCHAR) AS ops_field,
       't' || CAST(conv_id % 3 AS VARCHAR) AS task_type,
       list(text ORDER BY turn) AS question,
       conv_id AS seq
FROM conversations WHERE role = 'user' GROUP BY conv_id""")

view("reference_answers", [], """
SELECT conv_id AS question_id, 'expert' AS model_id, list(text ORDER BY turn) AS model_answer
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")

view("answer_log", [], f"""
SELECT user_id AS question_id,
       'm' || CAST(event_id % CASE WHEN user_id % 5 = 0 THEN 3 ELSE 4 END AS VARCHAR) AS model,
       [event_type || ' answer ' || CAST(event_id AS VARCHAR)
          || CASE WHEN event_id % 5 = 0 THEN '{STOP_MARKER} trailing text' ELSE '' END,
        event_type || ' follow-up ' || CAST(event_id AS VARCHAR)] AS model_answer,
       event_id AS seq,
       CAST(event_id AS DOUBLE) AS tstamp
FROM (SELECT event_id, event_type, user_id % ((SELECT max(conv_id) FROM conversations) + 1) AS user_id FROM events)""")

view("question_labels", [], f"""
SELECT c_custkey AS question_id, c_mktsegment AS label,
       'n' || CAST(c_nationkey % 5 AS VARCHAR) AS label2,
       {CATS}[c_custkey % 9 + 1] AS category,
       CAST(1 + c_custkey % 2 AS INTEGER) AS n_turns
FROM customer""")

view("single_log", [], """
SELECT question_id, CASE WHEN l_orderkey % 3 = 0 THEN 'bench_b' ELSE 'bench_a' END AS bench,
       'm' || CAST(l_suppkey % 6 AS VARCHAR) AS model,
       'gpt-4' AS judge_model,
       CASE WHEN l_linenumber % 2 = 0 THEN 'single-v1' ELSE 'single-v1-multi-turn' END AS judge_prompt,
       'Question ' || CAST(question_id AS VARCHAR) || ' answered by m' || CAST(l_suppkey % 6 AS VARCHAR) AS user_prompt,
       CASE l_partkey % 7
         WHEN 0 THEN 'Rating: [[' || CAST(l_linenumber + 1 AS VARCHAR) || ']]'
         WHEN 1 THEN 'Rating: [' || CAST(l_linenumber + 1 AS VARCHAR) || ']'
         WHEN 2 THEN 'Rating: [[' || CAST(l_linenumber + 1 AS VARCHAR) || '.5]]'
         WHEN 3 THEN 'No rating given'
         WHEN 4 THEN '$ERROR$'
         WHEN 5 THEN 'First [[' || CAST(l_linenumber + 1 AS VARCHAR) || ']] then [[' || CAST(l_linenumber + 2 AS VARCHAR) || ']]'
         ELSE 'Rating: [[0' || CAST(l_linenumber + 1 AS VARCHAR) || ']]' END AS judgment,
       CAST(1 + l_linenumber % 2 AS INTEGER) AS turn,
       {'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey, 's': l_suppkey} AS seq
FROM (SELECT *, CAST(1 + l_orderkey % (SELECT max(c_custkey) FROM customer) AS BIGINT) AS question_id FROM lineitem)""")

view("pair_log", [], """
SELECT o_custkey AS question_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'bench_b' ELSE 'bench_a' END AS bench,
       'm' || CAST(o_orderkey % 4 AS VARCHAR) AS model_1,
       'm' || CAST((o_orderkey % 4 + 1 + (o_orderkey // 4) % 3) % 4 AS VARCHAR) AS model_2,
       CASE WHEN o_orderstatus = 'F' THEN 'gpt-4' ELSE 'gpt-3.5-turbo' END AS judge_model,
       CASE WHEN o_orderstatus = 'P' THEN 'pair-math-v1' ELSE 'pair-v2' END
         || CASE WHEN o_orderkey % 2 = 1 THEN '-multi-turn' ELSE '' END AS judge_prompt,
       'Compare answers to question ' || CAST(o_custkey AS VARCHAR) AS g1_user_prompt,
       'Compare answers (swapped) to question ' || CAST(o_custkey AS VARCHAR) AS g2_user_prompt,
       CASE o_orderkey % 5
         WHEN 0 THEN 'Assistant A is better. [[A]]'
         WHEN 1 THEN 'Assistant B is better. [[B]]'
         WHEN 2 THEN 'Both are equal. [[C]]'
         WHEN 3 THEN 'Torn: [[A]] or maybe [[B]]'
         ELSE 'I cannot decide.' END AS g1_judgment,
       CASE o_orderkey % 7
         WHEN 0 THEN 'Verdict: [[A]]'
         WHEN 1 THEN 'Verdict: [[B]]'
         WHEN 2 THEN 'Verdict: [[C]]'
         WHEN 3 THEN '[[B]] first, final [[A]]'
         WHEN 4 THEN 'Verdict [A]'
         WHEN 5 THEN 'verdict [[a]]'
         ELSE '$ERROR$' END AS g2_judgment,
       CAST(CASE WHEN o_orderkey % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS turn,
       o_orderkey AS seq,
       CAST(o_orderkey AS DOUBLE) AS tstamp
FROM orders""")

view("two_score_log", [], """
SELECT o_orderkey AS seq, o_custkey AS question_id,
       CASE o_orderkey % 6
         WHEN 0 THEN 'Scores [[' || CAST(o_orderkey % 10 AS VARCHAR) || ',' || CAST((o_orderkey // 10) % 10 AS VARCHAR) || ']]'
         WHEN 1 THEN 'Scores [[' || CAST(o_orderkey % 10 AS VARCHAR) || ', ' || CAST((o_orderkey // 10) % 10 AS VARCHAR) || '.9]]'
         WHEN 2 THEN 'Scores [' || CAST(o_orderkey % 10 AS VARCHAR) || ', ' || CAST((o_orderkey // 10) % 10 AS VARCHAR) || ']'
         WHEN 3 THEN 'Scores [[0.4,0.3]]'
         WHEN 4 THEN 'Scores [[' || CAST(o_orderkey % 10 AS VARCHAR) || ',' || CAST(o_orderkey % 10 AS VARCHAR) || '.05]]'
         ELSE 'No scores' END AS judgment
FROM orders""")

view("mc_items", [], """
SELECT p_partkey AS id, p_name AS question, p_brand AS "A", p_type AS "B",
       CAST(p_size AS VARCHAR) AS "C",
       CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) AS "D",
       ['A', 'B', 'C', 'D'][p_partkey % 4 + 1] AS answer,
       's' || CAST(p_partkey % 5 AS VARCHAR) AS subject,
       p_type AS category,
       p_partkey % 50 < 5 AS is_shot
FROM part""")

view("mc_questions", ["mc_items"], """
SELECT id, question, "A", "B", "C", "D", answer, subject, category FROM mc_items WHERE NOT is_shot""")

view("mc_shots", ["mc_items"], """
SELECT id, question, "A", "B", "C", "D", answer, subject, category FROM mc_items WHERE is_shot""")

_runs = " UNION ALL ".join(
    f"SELECT {i} AS run, '{m}' AS model, {n} AS ntrain, {'TRUE' if c else 'FALSE'} AS cot"
    for i, (m, n, c) in enumerate(MC_RUNS))
view("mc_runs", [], _runs)

view("mc_outputs", ["mc_questions", "mc_runs"], """
SELECT q.*, r.run, r.model, r.ntrain, r.cot,
  CASE (q.id + r.run) % 10
    WHEN 0 THEN ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1]
    WHEN 1 THEN 'The answer is ' || ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1] || '.'
    WHEN 2 THEN '答案是：' || ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1]
    WHEN 3 THEN '选项说明，answer is （' || ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1] || '）'
    WHEN 4 THEN '答案是' || ['A','B','C','D'][(q.id // 3 + r.run + 1) % 4 + 1] || '，不对，答案是' || ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1]
    WHEN 5 THEN 'I have no idea.'
    WHEN 6 THEN '   '
    WHEN 7 THEN '　　' || ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1]
    WHEN 8 THEN 'Because the answer is ' || ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1]
    ELSE 'the answer is The ' || ['A','B','C','D'][(q.id // 3 + r.run) % 4 + 1] END AS model_output
FROM mc_questions q, mc_runs r""")

def _mc_results_sql() -> str:
    from gradebook.plans.sql_snippets import mc_letter_sql, ustrip_sql
    return f"""
SELECT *, CAST(coalesce(lower(letter) = lower(answer), FALSE) AS INTEGER) AS correct FROM (
  SELECT *, {mc_letter_sql("r")} AS letter FROM (
    SELECT *, {ustrip_sql("model_output")} AS r FROM mc_outputs) x) y"""


view("mc_results", ["mc_outputs"], _mc_results_sql())

view("ratings", [], """
SELECT d.doc_id,
  CASE WHEN d.doc_id % 13 = 0
    THEN '{"score": ' || CAST(1 + 3 * l.quality + (1 - l.toxic) AS VARCHAR) || ', "reason": "cut off'
    ELSE '{"score": ' || CAST(1 + 3 * l.quality + (1 - l.toxic) AS VARCHAR) || ', "reason": "reason '
         || CAST(d.doc_id AS VARCHAR) || '", "modified_data": '
         || CASE WHEN d.doc_id % 2 = 0
              THEN '{"instruction": "improved instruction ' || CAST(d.doc_id AS VARCHAR)
                   || '", "input": "", "output": "improved output ' || CAST(d.doc_id AS VARCHAR) || '"}'
              ELSE '"None"' END || '}' END AS rating_text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")

view("generations", [], """
SELECT doc_id, regexp_replace(text, '(?m)^', '1. ', 'g') AS generated FROM documents""")


def with_views(names: list[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"

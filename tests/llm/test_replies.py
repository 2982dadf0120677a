import pytest

from tamarack.llm.replies import defect, defective_replies

Q = "Which pending orders from id 12 on cost at least 3.50 and at most 9.75?"
DE = "Welche Zahlungen nach 12 wurden per invoice geleistet oder haben Status refunded?"
S = "SELECT order_id FROM orders WHERE total BETWEEN 3.50 AND 9.75 AND status = 'pending' ORDER BY order_id ASC"
CASES = [
    (Q, S, None),
    (Q, f"```sql\n{S}\n```", None),
    (Q, f"```sql\n{S}", None),
    (Q, f"<think>\nWe need orders.\n</think>\n\n{S};\n\nIt keeps only the rows you asked for.", None),
    (Q, f"I cannot use an inner join here because rows would be lost, so:\n{S}", None),
    (Q, f"{Q}\n\n{S}", None),
    (Q, f"-- {Q}\n{S}", None),
    (Q, "SELECT * FROM orders WHERE country = 'Côte d''Or'", None),
    (DE, f"Hier ist die Abfrage:\n\n{S}", None),
    (Q, None, "empty"),
    (Q, " \n​", "empty"),
    (Q, "```sql\n;\n```", "empty"),
    (Q, "<think>\nLet me see.\n</think>\n", "empty"),
    (Q, "...", "empty"),
    (Q, "PostgreSQL query:", "empty"),
    (Q, Q.upper(), "copied_question"),
    (Q, f"Question: {Q}\n\nPostgreSQL query:", "copied_question"),
    (Q, f"{Q}\n{Q}", "copied_question"),
    (Q, f"```sql\n-- {Q}\n```", "copied_question"),
    (Q, "which pending orders from id 12 on cost at least 350 and at most 975", "copied_question"),
    ("Who spent more than 9.50 since 2020-11 on orders?", "who spent more than 950 since 202011 on orders", "copied_question"),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"),
    (Q, "<think>\nHm.\n</think>\nThis is something I must decline. Please contact the data team.", "refusal"),
    (Q, "```sql\nSELECT 'Hmm, I won''t produce a statement for orders.' AS message;\n```", "refusal"),
    (Q, "-- Unfortunately, I do not have permission to look at orders.", "refusal"),
    (DE, "Das geht leider nicht. Diese Anfrage muss ich ablehnen.", "refusal"),
    (Q, "<think>\nWe need orders. Then the join", "truncated"),
    (Q, "The statement needs two parts:\n1. rows of orders\n2. the", "truncated"),
    (Q, "SELECT order_id, total FROM orders WHERE status = 'pen", "truncated"),
    (Q, "SELECT order_id FROM orders WHERE total BETWEEN 3.50", "truncated"),
    (Q, "SELECT order_id FROM orders WHERE a = 1 AND total", "truncated"),
    (Q, "```sql\nSELECT order_id FROM orders ORDER BY order_id ASC,\n```", "truncated"),
    (Q, "WITH s AS (SELECT a FROM t)", "truncated"),
    (Q, "SELECT a FROM t JOIN u", "truncated"),
    (Q, "SELECT a FROM t WHERE country = 'Côte d'", "truncated"),
    (Q, "SELECT a FROM t WHERE country = 'Côte d''", "truncated"),
    (Q, "SELECT a FROM t WHERE grade = 'd'", None),
    (Q, f"Voici la requête :\n\n{S}", "other_language"),
    (Q, f"{S};\n\nEs bleiben nur die gesuchten Zeilen übrig.", "other_language"),
    (Q, "まず orders を絞り込み、次に並べ替えます。", "other_language"),
    (DE, f"The following statement returns what you need.\n{S}", "other_language"),
    (None, f"Voici la requête :\n\n{S}", None),
]


@pytest.mark.parametrize("question,reply,kind", CASES)
def test_kinds(question, reply, kind):
    assert defect(question, reply) == kind


def test_join(spark):
    prompts = spark.createDataFrame([(str(i), q, "x") for i, (q, _, _) in enumerate(CASES)] + [("0", Q, "y")], "example_id string, question string, raw_output string")
    replies = spark.createDataFrame([(str(i), r) for i, (_, r, _) in enumerate(CASES)] + [("0", S), ("lone", "..."), (None, "")], "example_id string, raw_output string")
    got = {r.id: r.defect for r in defective_replies(replies, prompts).collect()}
    assert got == {str(i): k for i, (_, _, k) in enumerate(CASES) if k} | {"lone": "empty"}
    assert defective_replies(replies.limit(0), prompts).count() == 0


def test_long_reply():
    assert defect(Q, "SELECT a FROM t WHERE x IN (" + ", ".join(map(str, range(50_000))) + ")") is None
    assert defect(Q, "word " * 50_000) == "truncated"

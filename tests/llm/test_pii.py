"""Base spans against plain regular expressions, discovered ones against planted contexts."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import pii, queries

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [
        lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
        lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, p in enumerate((MAIL, IP, CARD, PHONE)) for m in p.finditer(text or "") if ok[k](m.group()))


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def row(doc, text):
    spans = brute(text)
    n = [sum(k == x for _, x, _ in spans) for k in range(4)]
    return (doc, *n, hashlib.sha256(listed(spans).encode()).hexdigest())


def base(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def made():
    rng = random.Random(9)
    atoms = ["a@b.co", "@", ".", "x", "1.2.3.4", "999.1.1.1", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (668) 555-1234",
             "+", "12", "-", " ", "é", "😀", "\n", "a.b%c@d-e.f.g", "7", "5500005555555559", "+44 20 7946 0958", "(", ")", "A"]
    docs = [(k, "".join(rng.choice(atoms) for _ in range(rng.randint(0, 25)))) for k in range(250)]
    docs += [(500, None), (501, ""), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co")]
    docs += [(502, "1" * 30000), (503, "1 " * 20000), (504, "a" * 30000 + "@b.c"), (505, "1." * 9000), (506, "x@" + "y." * 9000 + "z"), (507, "+" * 9000), (508, "+1" + "(" * 9000)]
    return docs


def test_base_equals_regular_expressions(spark, frame):
    docs = made()
    got = pii.report(pii.find(frame(docs).withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))))
    assert base(got) == sorted((row(*d) for d in docs), key=repr)


def test_given_table(spark, data):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    got = queries.op5_personal_data(spark, data)
    assert base(got) == sorted((row(*d) for d in docs), key=repr)


def planted():
    docs = [(k, f"Some text. Contact phone: +1 (668) 555-{1000 + k} thanks. More words") for k in range(30)]
    docs += [(100, "Some text. Contact phone: 668.555.7777 thanks. More words"), (101, "Filler 668.555.7777x filler"), (102, "room 4b near b12")]
    return docs


def test_contexts_find_unseen_identifiers(spark, frame):
    docs = planted()
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(frame(docs))).collect()}
    start = docs[30][1].index("668")
    assert got[100] == f"phone:{start}:{start + 12}"
    assert got[101] == got[102] == ""
    assert got[7] == listed(brute(docs[7][1]))


def test_right_words_and_pairs_of_words_find_unseen_identifiers(spark, frame):
    seed = lambda k: f"+1 (668) 555-{1000 + k}"
    # Only the word after tells the first, only both words together tell the second.
    docs = [(k, f"word{'abcdefghij'[k % 10]}{chr(97 + k // 10)} {seed(k)} rings") for k in range(30)]
    docs += [(100 + k, f"from {seed(100 + k)} until") for k in range(30)]
    docs += [(200 + k, f"from a{k}b onward") for k in range(60)] + [(300 + k, f"since a{k}b until") for k in range(60)]
    docs += [(500, "other 668.555.7777 rings"), (501, "from 668.555.8888 until"), (502, "from 668.555.9999 onward"), (503, "since 668.555.6666 until")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(frame(docs))).collect()}
    assert got[500] == "phone:6:18" and got[501] == "phone:5:17"
    assert got[502] == got[503] == ""


def test_identifiers_of_several_tokens_are_masked_whole(spark, frame):
    docs = planted()[:30] + [
        (400, "Contact phone: (668) 555-7777 thanks"), (401, "Contact phone: 668 555 - 7777, 12 of them"), (402, "Contact phone: 668 555\n12 rows"),
        (403, "Contact phone: 668 555 +1 (668) 555-1234 thanks"), (404, "Contact phone: 668 nobody 555")]
    text = {r["doc_id"]: r["text"] for r in pii.mask(frame(docs)).collect()}
    assert text[400] == "Contact phone: [PHONE] thanks"
    assert text[401] == "Contact phone: [PHONE], 12 of them"
    assert text[402] == "Contact phone: [PHONE]\n12 rows"
    assert "1234" not in text[403] and text[403].endswith("[PHONE] thanks")
    assert text[404] == "Contact phone: [PHONE] nobody 555"


def test_mask(spark, frame):
    docs = frame(planted() + [(200, None), (201, "mail a@b.co or 😀 c@d.ef!"), (201, "mail a@b.co or 😀 c@d.ef!"), (202, "plain")])
    got = pii.mask(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert text[201] == "mail [EMAIL] or 😀 [EMAIL]!" and text[202] == "plain" and text[200] is None
    assert text[100] == "Some text. Contact phone: [PHONE] thanks. More words"


def test_empty_table(spark, frame):
    assert pii.report(pii.find(frame([]))).count() == 0


def test_no_python_on_the_executors(spark, data):
    df = queries.op5_personal_data(spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mask_leaves_clashing_columns(spark, frame):
    docs = frame([(1, "mail a@b.co"), (2, "plain"), (2, None)])
    names = ["own_key", "pii_id", "PII_KEY", "pii_spans", "_pii_text", "doc", "spans"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"v{k}"))
    got = pii.mask(docs)
    assert got.columns == docs.columns
    assert all(tuple(r[n] for n in names) == tuple(f"v{k}" for k in range(7)) for r in got.collect()) and got.count() == 3
    assert pii.mask(frame([])).count() == 0

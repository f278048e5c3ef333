import hashlib
import random
import re

from weftline.llm.pii import KINDS, personal_data, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, spans string, base int, v string"


def luhn(d):
    return sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text or "") if good(kind, m[0])]
    return sorted(found)


def joined(found):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def texts():
    rng = random.Random(4)
    bits = ["a@b.c", "+d@e.f", "x.y%z@mail.example.com.", "1.2.3.4", ".5.6.7.8", "999.1.1.1", "0010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0199", "+12", "é", "😀", " ", "\n", "12", "-", "word", "@", "."]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    out += [None, "", "1 " * 3000, "a" * 50_000, "a.b" * 20_000 + "@c.d", "7" * 30_000, "x@" + "a." * 5000 + "b", "+1" + "-" * 9000]
    return [*out, "me@here.org " * 700]


def test_base_spans_equal_python(spark):
    docs = list(enumerate(texts())) + [(3, "a@b.c"), (3, "a@b.c"), (None, "+1 (555) 555-0199")]
    df = spark.createDataFrame([(d, t, "clash", 1, "x") for d, t in docs], SCHEMA)
    rows = sorted(map(tuple, personal_data(df).drop("spans").collect()), key=str)
    want = []
    for d, t in docs:
        found = brute(t)
        want.append((d, *(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(joined(found).encode()).hexdigest()))
    assert rows == sorted(want, key=str)


def test_contexts_find_an_identifier_that_no_pattern_matches(spark):
    docs = [(k, f"please ring +1 (555) 555-01{k:02d} today", "", 0, "") for k in range(12)] + [(50, "please ring 0555-QX-77 today", "", 0, ""), (51, "room 12345 is free", "", 0, "")]
    rows = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert rows[50] == "phone:12:22" and rows[51] == ""
    assert all(rows[k].startswith("phone:12:") for k in range(12))


def test_redact_replaces_spans_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "é mail me@here.org or +1 (555) 555-0199.", "s", 2, "v"), (2, None, "s", 3, "v"), (3, "nothing", "s", 4, "v")], SCHEMA)
    out = redact(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "é mail <EMAIL> or <PHONE>.", 2: None, 3: "nothing"}


def test_an_empty_table(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chains_of_contexts_are_followed_to_their_end(spark):
    # values of each step stand in its contexts and in those of the next step; only the first are phones by pattern
    docs, last = [], {}
    for step, n in enumerate((64, 16, 4, 1)):
        for k in range(n):
            value = f"+1 (555) 555-01{k:02d}" if step == 0 else f"{step}x{k}" + "q" * (70 if k == 0 else 2)
            for at in "abcde"[step : step + 2]:
                docs.append((len(docs), f"lead{at} {value} tail{at}", "", 0, ""))
                last[docs[-1][0]] = f"phone:6:{6 + len(value)}"
    got = {r["doc_id"]: r["spans"] for r in personal_data(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == last

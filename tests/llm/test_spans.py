"""Personal data and decontamination against brute force."""

import hashlib
import re

import pytest

from oracle import compare, duck
from spanloom.llm import decontam, pii
from spanloom.llm.queries import op1_pii, op2_decontamination

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    digits = [int(c) for c in d][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d)
                    or kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def check(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in PLAIN] == want


def test_query_is_brute_force(spark, docs, small):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op1_pii(spark, small).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_hard_texts(make, odd):
    texts = [*odd, "a@b.c.d@e.f", "@@x@y", "x@y@z.com", "me@-.-", "1.2.3.4.5.6.7.8", "001.02.3.255 1.2.3.256", "4111 1111 1111 1111 2", "4111-1111-1111-1111", "+1 (555) 010-9999",
             "+12 +3456789012", "card 5500 0000 0000 0004, x@y.zz", "ü a.b@c.de 10.0.0.1", "4111111111111111 " * 50, "@" * 20_000, "a" * 30_000 + "@", "+1" + " " * 20_000]
    df = make(texts, spans="clash", id=3)
    check(pii.report(pii.find(df)).collect(), dict(enumerate(texts)))


def test_own_kinds_and_redaction(make):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 yes", "DE88370400440532013000", "my ssn 123-45-6789", "part 123-45-6789", "token = 24be64439e3e49cf46b2d7c90f3602a3", "24be64439e3e49cf46b2d7c90f3602a3", None, "write x@y.zz now"]
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(make(texts)).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["secret"], 5: [], 6: [], 7: ["email"]}
    out = {r.doc_id: r.text for r in pii.redacted(make(texts)).collect()}
    assert out[7] == "write [EMAIL] now" and out[6] is None and out[0] == "IBAN [IBAN] yes" and out[1] == texts[1]


def test_iban_before_upper_case_words_and_long_secrets(make):
    iban, key = "DE89 3704 0044 0532 0130 00", "aB3" * 100
    texts = [f"{iban} BIC COBADEFF", f"IBAN {iban} GB82 WEST 1234 5698 7654 32", f"ID42 {iban} BIC", f"token = {key} end", "token = " + "k9" * 200_000]
    out = {r.doc_id: r.text for r in pii.redacted(make(texts)).collect()}
    assert out == {0: "[IBAN] BIC COBADEFF", 1: "IBAN [IBAN] [IBAN]", 2: "ID42 [IBAN] BIC", 3: "token = [SECRET] end", 4: "token = [SECRET]"}


def test_decontamination_is_sql(spark, small):
    assert compare(op2_decontamination(spark, small), duck(small), decontam.REPORT_SQL) == ""


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contaminated(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        m = min(13, len(b))
        for p in {tuple(b[j:j + m]) for j in range(len(b) - m + 1)} if m else ():
            for s in range(len(w) - m + 1):
                if tuple(w[s:s + m]) == p:
                    hit |= set(range(s, s + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_hard_texts(spark, make, odd):
    long = " ".join(f"w{i % 17}" for i in range(60))
    items = [(10, "Alpha beta"), (9, "alpha"), (100, long), (7, None), (8, "..."), (6, "é x Y"), (5, long), (4, "w1 w1 w1 w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [*odd, "alpha BETA gamma", "ALPHA", "É x y é X Y", long, long + " tail " + long, "w1 " * 40, " ".join(f"w{i % 17}" for i in range(5, 300)), "w1 w1 w1 w1 " + "z " * 76, "w1 w1 w1 w1 " + "z " * 77]
    for r in decontam.contamination(make(texts, n_hit="clash", items=1), bench).collect():
        n, hit, found = contaminated(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found), texts[r.doc_id][:60]
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_decontamination_edges(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_items for r in decontam.report(decontam.contamination(make(["a b"]), none)).collect()] == [0]
    assert decontam.contamination(make(["a"]).where("false"), none).count() == 0
    with pytest.raises(ValueError):
        decontam.contamination(make(["a"]), spark.createDataFrame([(1, "abc")], "item_id long, text string"), max_benchmark_bytes=2)


def test_decontamination_items_without_id_and_benchmarks_in_blocks(spark, make):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(None, "alpha beta"), (None, "gamma"), (3, long), (4, "gamma delta")]
    texts = ["x alpha beta y", "gamma delta alpha beta", "start " + long + " gamma", "clean", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = [tuple(r) for r in decontam.contamination(make(texts), bench).orderBy("doc_id").collect()]
    assert whole == [(0, 4, 2, [None], True), (1, 4, 4, ["4", None], True), (2, 42, 41, ["3", None], True), (3, 1, 0, [], False), (4, 0, 0, [], False)]
    parts = decontam.contamination(make(texts), bench, max_benchmark_bytes=len(long))
    assert [tuple(r) for r in parts.orderBy("doc_id").collect()] == whole
    con = duck_of(documents=list(enumerate(texts)), benchmark=items)
    want = con.execute(decontam.REPORT_SQL + " ORDER BY 1").fetchall()
    assert [tuple(r) for r in decontam.report(parts).orderBy("doc_id").collect()] == want


def duck_of(documents, benchmark):
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", documents)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", benchmark)
    return con


def test_ibans_end_where_they_hold():
    from spanloom.llm import pii

    found = lambda t: [t[a:b] for a, b in pii.ibans(t)]
    assert found("DE89 3704 0044 0532 0130 00 BIC COBADEFF") == ["DE89 3704 0044 0532 0130 00"]
    assert found("to GB29NWBK60161331926819, FR1420041010050500013M02606.") == ["GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    assert found("xDE89370400440532013000 DE89370400440532013000x DE88370400440532013000 DE8937") == []


def test_ibans_take_time_in_proportion():
    import time

    from spanloom.llm import pii

    for text in (("AB12" + "A" * 40 + " ") * 22_000, "AB12 " * 100_000, "A1" * 500_000):
        start = time.perf_counter()
        assert list(pii.ibans(text)) == []
        assert time.perf_counter() - start < 20

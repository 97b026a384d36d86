import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from innsight.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


@pytest.fixture(scope="module")
def run(docs_of):
    def go(texts, key="k"):
        rows = pii.pseudonymise(docs_of(list(enumerate(texts))), key).collect()
        return [r for _, r in sorted((r.doc_id, r) for r in rows)]

    return go


def test_values_change_in_format_and_stay_linked(run):
    texts = ["pay 4785380592391139### now", "4785 3805 9239 1139 and 4785-3805-9239-1139", "+1 (743) 555-3824, (743) 555-3824 or 743-555-3824.",
             "ip 152.143.123.131!! at 152.143.123.131", "ssn 123-45-6789", "1984-02-29 and 02/29/1984 and 29.02.1984 and 31/12/1999", "Mail hein.19@mail5.example.com or HEIN.19@mail5.example.com."]
    out = run(texts)
    a, b, c, d, e, f, g = (r.text for r in out)
    card = re.search(r"\d{16}", a)[0]
    assert luhn(card) and card != "4785380592391139" and a == f"pay {card}### now"
    assert re.sub(r"\D", "", b) == card * 2 and re.fullmatch(r"(\d{4} ){4}and \d{4}(-\d{4}){3}", b)
    phone = re.sub(r"\D", "", c[:17])[1:]
    assert c == f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}, ({phone[:3]}) {phone[3:6]}-{phone[6:]} or {phone[:3]}-{phone[3:6]}-{phone[6:]}." and phone != "7435553824"
    ips = re.findall(r"\d+(?:\.\d+){3}", d)
    assert len(set(ips)) == 1 and all(int(x) <= 255 for x in ips[0].split(".")) and ips[0] != "152.143.123.131"
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", e) and e != texts[4]
    iso, us, dotted, eu = f.split(" and ")
    day = dt.date.fromisoformat(iso)
    assert us == day.strftime("%m/%d/%Y") and dotted == day.strftime("%d.%m.%Y") and dt.datetime.strptime(eu, "%d/%m/%Y") and eu != "31/12/1999"
    mails = re.findall(r"\S+@\S+\.com", g)
    assert len(mails) == 2 and len(set(mails)) == 1 and "hein" not in g.lower()
    assert [(r.n_card, r.n_phone, r.n_ip, r.n_ssn, r.n_date, r.n_email) for r in out] == [
        (1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (0, 3, 0, 0, 0, 0), (0, 0, 2, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 4, 0), (0, 0, 0, 0, 0, 2)]
    assert [r.text for r in run(texts[:1], "other key")] != [a]


def feistel(value, a, b, kind, key="k"):
    own = hashlib.sha256(f"{key}|{kind}".encode()).hexdigest()
    left, right = divmod(value, b)

    def f(r, half):
        return int(hashlib.sha256(f"{own}|{r}|{half}".encode()).hexdigest()[:15], 16)

    for r in range(8):
        if r % 2 == 0:
            left = (left + f(r, right)) % a
        else:
            right = (right + f(r, left)) % b
    return left * b + right


def moved(day, day_first=False):
    first = dt.date(1900, 1, 1)
    n = (day - first).days
    while True:
        n = feistel(n, 365, 200, "date")
        if not day_first or (first + dt.timedelta(n)).day > 12:
            return first + dt.timedelta(n)


def test_pseudonyms_equal_an_independent_feistel(run):
    out = [r.text for r in run(["4785380592391139", "743-555-3824", "10.20.30.40", "123-45-6789", "1984-02-29", "31/12/1999", "+442079460958"])]
    payload = f"{feistel(478538059239113, 10 ** 8, 10 ** 7, 'card'):015d}"
    assert out[0][:15] == payload and luhn(out[0])
    phone = f"{feistel(7435553824, 10 ** 5, 10 ** 5, 'phone'):010d}"
    assert out[1] == f"{phone[:3]}-{phone[3:6]}-{phone[6:]}"
    ip = feistel(int.from_bytes(bytes([10, 20, 30, 40])), 65536, 65536, "ip")
    assert out[2] == ".".join(map(str, ip.to_bytes(4)))
    number = feistel(((123 - 1) * 99 + 45 - 1) * 9999 + 6789 - 1, 898 * 99, 9999, "ssn")
    area, group, serial = number // (99 * 9999), number // 9999 % 99, number % 9999
    assert out[3] == f"{area + (1 if area < 665 else 2):03d}-{group + 1:02d}-{serial + 1:04d}"
    assert out[4] == moved(dt.date(1984, 2, 29)).isoformat() and out[5] == moved(dt.date(1999, 12, 31), True).strftime("%d/%m/%Y")
    assert out[6] == f"+44{feistel(2079460958, 10 ** 5, 10 ** 5, 'phone'):010d}"


def test_different_dates_get_different_pseudonyms(run):
    """Month-first and day-first slash dates, every day of ten years."""
    days = [dt.date(1980, 1, 1) + dt.timedelta(i) for i in range(3653)]
    texts = [d.strftime("%m/%d/%Y") for d in days] + [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    assert len(set(texts)) == len(texts)
    got = re.findall(r"\d\d/\d\d/\d{4}", run([" ".join(texts)])[0].text)
    assert len(got) == len(texts) == len(set(got))


def test_time_stamps_and_international_numbers(run):
    stamp, day, spaced, compact, short = (r.text for r in run(["at 2024-01-05T10:00:00Z", "at 2024-01-05 10:00", "tel +44 20 7946 0958.", "tel +14155552671", "+49 30 12"]))
    assert stamp[3:13] == day[3:13] != "2024-01-05" and stamp.endswith("T10:00:00Z")
    assert re.fullmatch(r"tel \+44 \d\d \d{4} \d{4}\.", spaced) and "7946 0958" not in spaced
    assert re.fullmatch(r"tel \+1\d{10}", compact) and "4155552671" not in compact and short == "+49 30 12"


def test_secret_is_not_in_the_plan(docs_of):
    from conftest import plan_text

    assert "very-secret" not in plan_text(pii.pseudonymise(docs_of([(1, "a")]), "very-secret"))


def test_long_runs_of_one_sign(run):
    """A megabyte of what the patterns repeat is read, and left as it is."""
    texts = ["x@" + "a." * 500_000 + "com", "." * 1_000_000, "@" * 1_000_000, "7" * 1_000_000, "a@" * 500_000, "1." * 500_000, "+1 " * 300_000, "\n" * 1_000_000, "a-" * 500_000 + "@b.example"]
    out = run(texts)
    assert [r.text for r in out[:8]] == texts[:8]
    assert out[8].n_email == 0 or "@b.example" not in out[8].text


def test_what_fails_validation_stays(run):
    texts = ["2123465659789240", "300.1.2.3 and 1.2.3.4.5", "000-12-3456 666-12-3456 900-12-3456 123-00-4567", "1984-02-30 2024-13-01 31.04.2020 1850-01-01",
             "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "order 12345 of 2024, 99.9 %, v1.2.3", "0000000000000000", "a @ b, x@y"]
    assert [r.text for r in run(texts)] == texts


def test_odd_documents(docs_of, odd_docs):
    docs = docs_of(odd_docs).withColumn("_m", F.lit("clash")).withColumn("c0", F.lit(1))
    got = pii.pseudonymise(docs, "k")
    assert got.columns == ["doc_id", "text", "_m", "c0", *(f"n_{k}" for k in pii.KINDS)]
    for r in got.collect():
        same = [t for i, t in odd_docs if i == r.doc_id]
        if r.doc_id == 10:
            assert (r.n_email, r.n_card) == (1, 1) and "a.b@c" not in r.text and luhn(r.text.split(" ", 1)[1])
        else:
            assert r.text in same and r._m == "clash"
    assert pii.pseudonymise(docs_of([]), "k").collect() == []


@pytest.mark.parametrize("a,b", [(365, 200), (100, 10), (1, 7), (1000, 1000)])
def test_feistel_permutes(spark, a, b):
    n = a * b
    values = spark.range(n).select(pii.feistel(F.col("id"), a, b, "key", "x").alias("v"))
    r = values.agg(F.count_distinct("v"), F.min("v"), F.max("v")).first()
    assert tuple(r) == (n, 0, n - 1)


def test_no_python_runs(spark):
    from conftest import plan_text

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert not re.search("Python|Pandas|Arrow", plan_text(pii.pseudonymise(docs, "k")))

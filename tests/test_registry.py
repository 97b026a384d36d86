import pytest

from innsight.config import EmailConfig, Ga4Config, TenantConfig
from innsight.plans.tenants import entitled_pages, resolve_tenants
from innsight.sources.registry import (
    DuplicateTenant, load_registry, load_registry_or_fallback, load_users, seed_customers, tenant_configs,
)

CUSTOMERS = [
    (" Aurora ", "", " aur ", '["book_date","nope","audience"]', '{"table":"t","buckets":[["a","A"]]}', "{bad json", True),
    ("boreal", "B", "bor", None, None, '{"database":"d","schema":"s","report":"R"}', None),
    ("shut", "S", "s", "[]", "{}", None, False),
]
CUST_SCHEMA = "CUSTOMER string, LABEL string, PREFIX string, PAGES string, EMAIL_CONFIG string, GA4_CONFIG string, ACTIVE boolean"


def test_load_registry_decodes_and_normalises(spark):
    reg = load_registry(spark.createDataFrame(CUSTOMERS, CUST_SCHEMA))
    rows = {r.customer: r for r in reg.collect()}
    assert set(rows) == {"aurora", "boreal"}
    a, b = rows["aurora"], rows["boreal"]
    assert (a.label, a.prefix, a.pages) == ("aurora", "AUR", ["book_date", "nope", "audience"])
    assert a.email.table == "t" and a.email.buckets == [["a", "A"]]
    assert a.ga4 is None  # malformed JSON -> no config
    assert b.pages == [] and b.ga4.report == "R"
    cfgs = {c.customer: c for c in tenant_configs(reg)}
    assert cfgs["aurora"].email == EmailConfig("t", buckets=(("a", "A"),))
    assert cfgs["boreal"].ga4 == Ga4Config("d", "s", "R")


def test_registry_without_ga4_column(spark):
    df = spark.createDataFrame(CUSTOMERS, CUST_SCHEMA).drop("GA4_CONFIG")
    assert all(r.ga4 is None for r in load_registry(df).collect())


def test_registry_rejects_duplicates(spark):
    df = spark.createDataFrame(CUSTOMERS + [("AURORA", "x", "y", None, None, None, True)], CUST_SCHEMA)
    with pytest.raises(DuplicateTenant):
        load_registry(df)


def test_registry_fallback(spark):
    fb = [TenantConfig("demo", "Demo", "DEMO", ("book_date",))]
    reg = load_registry_or_fallback(spark, "no_such_registry_table", fb)
    assert [r.customer for r in reg.collect()] == ["demo"]


def test_seed_round_trip(spark):
    t = TenantConfig("x", "X", "XP", ("audience",), EmailConfig("mail", buckets=(("d", "D"),)), Ga4Config("a", "b", "c"))
    back = tenant_configs(load_registry(seed_customers(spark, [t])))
    assert back == [TenantConfig("x", "X", "XP", ("audience",), EmailConfig("mail", buckets=(("d", "D"),)), Ga4Config("a", "b", "c"))]


def _users(spark):
    rows = [
        (" Ann@X.com ", "Ann", "Aurora ", True, 1),
        ("ann@x.com", "", "boreal", None, 2),  # same email, later: wins
        ("bob@x.com", "Bob", "ghost", True, 3),
        ("carl@x.com", "Carl", "aurora", False, 4),  # inactive
        ("  ", "Blank", "aurora", True, 5),  # blank email skipped
    ]
    return spark.createDataFrame(rows, "EMAIL string, NAME string, CUSTOMER string, ACTIVE boolean, CREATED_AT bigint")


def test_users_and_resolution(spark):
    users = load_users(_users(spark))
    got = {r.email: r for r in users.collect()}
    assert set(got) == {"ann@x.com", "bob@x.com"}
    assert (got["ann@x.com"].name, got["ann@x.com"].customer) == ("ann@x.com", "boreal")
    reg = load_registry(spark.createDataFrame(CUSTOMERS, CUST_SCHEMA))
    res = {r.email: r for r in resolve_tenants(users, reg).collect()}
    assert res["ann@x.com"].authorized and res["ann@x.com"].prefix == "BOR"
    assert not res["bob@x.com"].authorized and res["bob@x.com"].label is None


def test_entitled_pages_order_and_unknown_dropped(spark):
    users = spark.createDataFrame([("u@x", "u", "aurora")], "email string, name string, customer string")
    reg = load_registry(spark.createDataFrame(CUSTOMERS, CUST_SCHEMA))
    pages = entitled_pages(resolve_tenants(users, reg), reg).orderBy("position").collect()
    assert [(p.page, p.title) for p in pages] == [("book_date", "Book Date"), ("audience", "Audience")]
    assert [p.position for p in pages] == [0, 2]  # configured order; the unknown page is dropped

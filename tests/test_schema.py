import pytest

from larkspur.functions import fragments, identifiers
from larkspur.operators import scope
from larkspur.plans import ddl, ordering


@pytest.mark.parametrize(
    "text,postgres,mssql,mysql",
    [
        ("(getdate())", "CURRENT_TIMESTAMP", "SYSDATETIME()", "CURRENT_TIMESTAMP"),
        ("now() AT TIME ZONE 'utc'", "(CURRENT_TIMESTAMP AT TIME ZONE 'UTC')", "SYSUTCDATETIME()", "UTC_TIMESTAMP"),
        ("N'it''s'", "'it''s'", "'it''s'", "'it''s'"),
        ("((-1))", "-1", "-1", "-1"),
        ("true", "true", "1", "1"),
        ("[a] >= 0 AND ([b] IS NULL OR [b] <> 'x')", "(\"a\" >= 0) AND ((\"b\" IS NULL) OR (\"b\" <> 'x'))", "([a] >= 0) AND (([b] IS NULL) OR ([b] <> 'x'))", "(`a` >= 0) AND ((`b` IS NULL) OR (`b` <> 'x'))"),
        ("(status)::text = ANY (ARRAY['a'::text, 'b'::text])", "\"status\" IN ('a', 'b')", "[status] IN ('a', 'b')", "`status` IN ('a', 'b')"),
        ("a || 'x'", "\"a\" || 'x'", "CONCAT([a], 'x')", "CONCAT(`a`, 'x')"),
        ("[c] LIKE '[0-9]%'", "\"c\" ~ '^[0-9].*$'", "[c] LIKE '[0-9]%'", "`c` REGEXP '^[0-9].*$'"),
        ("c ~ '^#[0-9a-f]{2}$'", "\"c\" ~ '^#[0-9a-f]{2}$'", "[c] LIKE '#[0-9a-f][0-9a-f]'", "`c` REGEXP '^#[0-9a-f]{2}$'"),
        ("ISNULL(a, lower(b))", 'COALESCE("a", LOWER("b"))', "COALESCE([a], LOWER([b]))", "COALESCE(`a`, LOWER(`b`))"),
    ],
)
def test_fragments_are_rendered_for_each_dialect(text, postgres, mssql, mysql):
    node = fragments.parse(text)
    assert [fragments.render(node, t) for t in ("postgres", "mssql", "mysql")] == [postgres, mssql, mysql]


@pytest.mark.parametrize("text", ["nextval('s')", "CASE WHEN a THEN b END", "a LIKE 'x' ESCAPE '!'", "SELECT 1", "a +", "now() AT TIME ZONE 'CET'", "(", "a ; b"])
def test_what_the_grammar_does_not_know_is_refused(text):
    node = fragments.parse(text)
    assert node == ("raw", text)
    for target in ("postgres", "mssql", "mysql", "spark"):
        with pytest.raises(fragments.Unknown):
            fragments.render(node, target)


def test_a_regular_expression_beyond_like_is_refused():
    with pytest.raises(fragments.Unknown):
        fragments.render(fragments.parse("c ~ '^(a|b)+$'"), "mssql")


def test_fragments_that_mean_the_same():
    assert fragments.same("getdate()", "GETUTCDATE()") and fragments.same("((0))", "false") and fragments.same("a IN (1, 2)", "a in (2,1)") and fragments.same("'A'", "'a'")
    assert fragments.same("CAST(getdate() AS date)", "CURRENT_DATE") and not fragments.same("1", "2") and not fragments.same("nextval('a')", "nextval('b')")


def test_long_identifiers_are_cut_between_characters(spark):
    names = ["é" * 40, "a" * 63, "a" * 64, "1x", "", "A b-c"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r.f for r in rows.select("i", identifiers.folded(rows.n).alias("f")).orderBy("i").collect()]
    import zlib

    assert got[0] == "é" * 27 + f"_{zlib.crc32(names[0].encode()):08x}" and got[1] == names[1]
    assert got[2] == "a" * 54 + f"_{zlib.crc32(names[2].encode()):08x}" and got[3:] == ["col_1x", "col_", "a_b_c"]


def test_drop_order_goes_on_in_cycles():
    got = dict(ordering.drop_levels(["a", "b", "c", "d"], [("a", "b"), ("b", "a"), ("c", "a"), ("d", "d")]))
    assert got["c"] == got["d"] == 0 and got["a"] == got["b"] == 1


def test_globs():
    assert scope.glob_pattern("a*[^b-c]?") == "^a[^/]*[^b-c][^/]$"
    with pytest.raises(ValueError):
        scope.glob_pattern("a[b")


def test_capabilities():
    assert ddl.dialect(" SQL-Server ") == "mssql" and ddl.supports("maria", "index_prefix")
    with pytest.raises(ValueError):
        ddl.create_index("clickhouse")
    with pytest.raises(ValueError):
        ddl.dialect("oracle")

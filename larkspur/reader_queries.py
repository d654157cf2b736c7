"""Queries of the catalog readers over the catalogs of an estate of lending libraries, with DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import estate
from larkspur.sources import readers

#: Columns and rows of each catalog relation.
RELATIONS = {
    "tables": ("table_schema, table_name, table_type", "('lib','shelf','BASE TABLE'), ('lib','Book','BASE TABLE'), ('lib','late','VIEW'), ('old','attic','BASE TABLE'), ('lib','loan','BASE TABLE')"),
    "pg_class": ("oid, relname, bytes, live", "(100,'book',81920,1000), (101,'loan',16384,0), (102,'shelf',8192,3), (201,'book_shelf_ix',0,0), (202,'book_pkey',0,0), (203,'loan_lower_ix',0,0), (204,'loan_open_ix',0,0)"),
    "pg_attribute": ("attrelid, attnum, attname", "(100,1,'id'), (100,2,'shelf_no'), (100,3,'title'), (100,5,'isbn'), (101,1,'book_id'), (101,2,'taken'), (101,3,'reader'), (102,1,'no'), (102,2,'hall')"),
    "pg_index": (
        "indexrelid, indrelid, indisprimary, indisunique, indkey, indnkeyatts, predicate, expressions",
        "(201,100,false,false,'5 2 3',2,NULL,NULL), (202,100,true,true,'1',1,NULL,NULL), (203,101,false,true,'0 2 0',3,NULL,'lower(reader);upper(note)'), (204,101,false,false,'1',1,'taken IS NULL',NULL)",
    ),
    "pg_constraint": (
        "conname, contype, conrelid, confrelid, conkey, confkey, confdeltype, confupdtype, consrc",
        "('book_pkey','p',100,0,'{1}',NULL,' ',' ',NULL), ('loan_pkey','p',101,0,'{3,1}',NULL,' ',' ',NULL), ('loan_book','f',101,100,'{1}','{1}','c','a',NULL), ('book_shelf','f',100,102,'{3,2}','{2,1}','n','r',NULL), ('loan_taken','c',101,0,'{2}',NULL,' ',' ','taken > 0'), ('book_isbn','c',100,0,'{5}',NULL,' ',' ','length(isbn) = 13')",
    ),
    "columns": (
        "table_name, ordinal, column_name, data_type, column_type, max_length, precision, scale, is_nullable, is_identity, column_default, is_generated, generation_expression, extra",
        """('book',1,'id','bigint','bigint unsigned',NULL,64,0,'NO','YES',NULL,'NEVER',NULL,'auto_increment'), ('book',2,'no','integer','int(11)',NULL,32,0,'NO','NO','nextval(''s''::regclass)','NEVER',NULL,''),
('book',3,'title','varchar','varchar(80)',80,NULL,NULL,'YES','NO','''x''','NEVER',NULL,NULL), ('book',4,'long','integer','int(10) Unsigned zerofill',NULL,32,0,'YES','NO',NULL,'ALWAYS','char_length(title)','STORED GENERATED'),
('loan',1,'kind','enum','enum(''a'',''it''''s'',''b\\''c, d'')',4,NULL,NULL,'NO','NO','''a''','NEVER',NULL,''), ('loan',2,'open','tinyint','tinyint(1)',NULL,3,0,'YES','NO','1','NEVER',NULL,'DEFAULT_GENERATED on update CURRENT_TIMESTAMP(3)'), ('loan',3,'at','geometry','geometry',NULL,NULL,NULL,'YES','NO',NULL,'ALWAYS','f(x)','VIRTUAL GENERATED')""",
    ),
    "spatial": ("table_name, column_name, subtype, srid", "('loan','at','POINT',4326), ('attic','at','POLYGON',0)"),
    "my_statistics": (
        "table_name, index_name, non_unique, seq_in_index, column_name, sub_part, expression",
        "('book','PRIMARY',0,1,'id',NULL,NULL), ('book','title_ix',1,2,'no',NULL,NULL), ('book','title_ix',1,1,'title',20,NULL), ('loan','odd_ix',0,1,NULL,NULL,'lower(`kind`)'), ('loan','odd_ix',0,2,'open',NULL,NULL), ('loan','plain_ix',1,1,'kind',NULL,NULL)",
    ),
    "my_usage": (
        "constraint_name, table_name, ordinal_position, column_name, referenced_table_name, referenced_column_name",
        "('PRIMARY','book',1,'id',NULL,NULL), ('PRIMARY','loan',2,'kind',NULL,NULL), ('PRIMARY','loan',1,'open',NULL,NULL), ('loan_fk','loan',2,'kind','book','no'), ('loan_fk','loan',1,'open','book','id'), ('u','book',1,'no',NULL,NULL)",
    ),
    "my_references": ("constraint_name, table_name, delete_rule, update_rule", "('loan_fk','loan','SET NULL','NO ACTION'), ('loan_fk','other','CASCADE','CASCADE')"),
    "my_checks": ("constraint_schema, constraint_name, check_clause", "('lib','loan_c','(`open` in (0,1))'), ('lib','book_c','(`no` > 0)'), ('old','book_c','(1)')"),
    "my_constraints": ("constraint_schema, constraint_name, table_name", "('lib','loan_c','loan'), ('lib','book_c','book')"),
    "ms_tables": ("object_id, name", "(1,'Book'), (2,'Loan')"),
    "ms_columns": ("object_id, column_id, name", "(1,1,'Id'), (1,2,'Title'), (1,3,'Length'), (1,4,'Hall'), (2,1,'BookId'), (2,2,'Hall'), (2,3,'Taken')"),
    "ms_list": (
        "table_name, ordinal, column_name, data_type, max_length, precision, scale, is_nullable, is_identity, column_default",
        "('Book',1,'Id','int',NULL,10,0,'NO',1,NULL), ('Book',2,'Title','nvarchar',-1,NULL,NULL,'YES',0,'(N''x'')'), ('Book',3,'Length','int',NULL,10,0,'YES',0,NULL), ('Loan',3,'Taken','datetime2',NULL,27,7,'NO',0,'(getdate())')",
    ),
    "ms_computed": ("object_id, column_id, definition, is_persisted", "(1,3,'(len([Title]))',1)"),
    "ms_indexes": ("object_id, index_id, name, is_unique, is_primary_key, filter_definition", "(1,0,NULL,0,0,NULL), (1,1,'PK_Book',1,1,NULL), (1,2,'IX_Title',0,0,NULL), (2,1,'PK_Loan',1,1,NULL), (2,3,'UX_Open',1,0,'([Taken] IS NULL)')"),
    "ms_index_columns": ("object_id, index_id, column_id, key_ordinal, is_included_column", "(1,1,1,1,0), (1,2,2,2,0), (1,2,4,1,0), (1,2,3,0,1), (1,2,1,0,1), (2,1,2,1,0), (2,1,1,2,0), (2,3,1,1,0)"),
    "ms_keys": ("constraint_object_id, fk_name, delete_action, update_action", "(9,'FK_Loan','SET_NULL','NO_ACTION')"),
    "ms_key_columns": ("constraint_object_id, constraint_column_id, parent_object_id, parent_column_id, referenced_object_id, referenced_column_id", "(9,2,2,2,1,4), (9,1,2,1,1,1)"),
    "ms_checks": ("object_id, name, definition", "(2,'CK_Taken','([Taken]>(0))'), (1,'CK_Id','([Id]>(0))')"),
    "ms_partitions": ("table_name, pages, row_count", "('Book',10,900), ('Book',6,100), ('Loan',0,0), ('Shelf',3,7)"),
    "fast_counts": ("table_name, fast", "('region',5), ('nation',-1), ('orders',0)"),
    "probes": ("table_name, index_name", "('BOOK','title_IX'), ('book','other'), ('loan','plain_ix')"),
}
LIST = ["columns", "ref_columns", "include_cols", "exprs", "prefixes", "enum_values"]


#: Columns by which objects are told apart in all databases.
NAMES = ("table_name", "relname", "referenced_table_name")
IDS = ("oid", "attrelid", "indexrelid", "indrelid", "conrelid", "confrelid", "object_id", "constraint_object_id", "parent_object_id", "referenced_object_id")
#: Names of other columns of some relations.
MORE_NAMES = {"my_checks": ("constraint_name",), "my_constraints": ("constraint_name",), "ms_tables": ("name",)}
#: Relations of which a database may lack rows.
LOOSE = ("tables", "columns", "spatial", "probes", "ms_partitions", "ms_checks", "my_references")


def _how(name: str) -> dict:
    return {"names": NAMES + MORE_NAMES.get(name, ()), "ids": IDS, "whole": name not in LOOSE}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, rows = RELATIONS[name]
    # string literals are written for DuckDB: Spark escapes by backslashes
    rows = re.sub(r"'((?:[^']|'')*)'", lambda m: "'" + m[1].replace("''", "'").replace("\\", "\\\\").replace("'", "\\'") + "'", rows)
    template = spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")
    return template if name == "fast_counts" else estate.rows(spark, sf_dir, template, **_how(name))


def _plain(df: DataFrame) -> DataFrame:
    """Lists as text, which both engines write alike."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in LIST if c in df.columns})


def _reader(make: Callable[..., DataFrame], *names: str):
    def query(spark, sf_dir):
        return _plain(make(*(relation(spark, sf_dir, n) for n in names)))

    return query


def _counts(spark, sf_dir):
    from larkspur.catalog_queries import row_count_exact

    return readers.row_count_or_exact(relation(spark, sf_dir, "fast_counts"), row_count_exact(spark, sf_dir))


QUERIES = {
    "list_tables": _reader(lambda t: readers.base_tables(t, "lib"), "tables"),
    "pg_columns_12": _reader(lambda c: readers.postgres_columns(c, 12), "columns"),
    "pg_columns_10": _reader(lambda c: readers.postgres_columns(c, 10), "columns"),
    "pg_columns_9": _reader(lambda c: readers.postgres_columns(c, 9), "columns"),
    "mysql_columns": _reader(readers.mysql_columns, "columns"),
    "mssql_computed_columns": _reader(lambda c, s, t, d: readers.mssql_computed(readers.mssql_columns(c), s, t, d), "ms_list", "ms_columns", "ms_tables", "ms_computed"),
    "spatial_columns": _reader(lambda c, s: readers.with_spatial(c.select("table_name", "column_name", "data_type"), s), "columns", "spatial"),
    "pg_primary_keys": _reader(readers.postgres_primary_keys, "pg_constraint", "pg_class", "pg_attribute"),
    "mysql_primary_keys": _reader(readers.mysql_primary_keys, "my_usage"),
    "mssql_primary_keys": _reader(readers.mssql_primary_keys, "ms_indexes", "ms_index_columns", "ms_columns", "ms_tables"),
    "pg_indexes": _reader(readers.postgres_indexes, "pg_index", "pg_class", "pg_attribute"),
    "mysql_indexes": _reader(readers.mysql_indexes, "my_statistics"),
    "mysql_indexes_old": _reader(lambda s: readers.mysql_indexes(s.where("column_name is not null").drop("expression")), "my_statistics"),
    "mssql_indexes": _reader(readers.mssql_indexes, "ms_indexes", "ms_index_columns", "ms_columns", "ms_tables"),
    "pg_foreign_keys": _reader(readers.postgres_foreign_keys, "pg_constraint", "pg_class", "pg_attribute"),
    "mysql_foreign_keys": _reader(readers.mysql_foreign_keys, "my_usage", "my_references"),
    "mssql_foreign_keys": _reader(readers.mssql_foreign_keys, "ms_keys", "ms_key_columns", "ms_columns", "ms_tables"),
    "pg_checks": _reader(lambda c, t: readers.checks(c.where("contype = 'c'"), t.select(F.col("oid").alias("conrelid"), F.col("relname").alias("table_name")), "conname", "consrc", ["conrelid"]), "pg_constraint", "pg_class"),
    "mysql_checks": _reader(lambda c, t: readers.checks(c, t, "constraint_name", "check_clause", ["constraint_schema", "constraint_name"]), "my_checks", "my_constraints"),
    "mssql_checks": _reader(lambda c, t: readers.checks(c, t.withColumnRenamed("name", "table_name"), "name", "definition", ["object_id"]), "ms_checks", "ms_tables"),
    "row_count_fallback": _counts,
    "pg_row_size": _reader(lambda t: readers.average_row_bytes(t.select(F.col("relname").alias("table_name"), F.col("bytes").alias("pages"), F.col("live").alias("row_count"))), "pg_class"),
    "mssql_row_size": _reader(lambda p: readers.widened(p.select("table_name").distinct().withColumn("row_bytes", F.lit(200)), readers.average_row_bytes(p, 8192)), "ms_partitions"),
    "table_exists": _reader(lambda p, t: readers.existing(p.select("table_name").distinct(), t, ["table_name"]), "probes", "columns"),
    "index_exists": _reader(lambda p, s: readers.existing(p, s, ["table_name", "index_name"]), "probes", "my_statistics"),
    "foreign_key_exists": _reader(lambda u, c: readers.existing(u.select("table_name", "constraint_name").distinct(), c.select("table_name", "constraint_name"), ["table_name", "constraint_name"]), "my_usage", "my_references"),
    "check_exists": _reader(lambda c, t: readers.existing(c.select("constraint_schema", "constraint_name"), t, ["constraint_schema", "constraint_name"]), "my_checks", "my_constraints"),
}

_COLUMNS = "table_name, ordinal, column_name, data_type, coalesce(max_length, 0) AS max_length, coalesce(precision, 0) AS precision, coalesce(scale, 0) AS scale, is_nullable = 'YES' AS is_nullable"
_SEQUENCE = "coalesce(column_default, '') LIKE 'nextval%'"


def _pg_columns(identity: str, computed: str) -> str:
    return f"SELECT {_COLUMNS}, {identity} AS is_identity, CASE WHEN NOT ({identity}) AND NOT ({computed}) THEN column_default END AS default_expr, {computed} AS is_computed, CASE WHEN {computed} THEN generation_expression END AS computed_expr FROM columns"


_UNNESTED = "SELECT *, unnest(string_split(trim(conkey, '{}'), ','))::INT AS mine, unnest(string_split(trim(confkey, '{}'), ','))::INT AS theirs, unnest(range(1, len(string_split(conkey, ',')) + 1)) AS place FROM pg_constraint"
_RULE = "CASE {} WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'r' THEN 'RESTRICT' WHEN 'd' THEN 'SET DEFAULT' ELSE 'NO ACTION' END"
_MY_INDEX = """SELECT table_name, index_name, non_unique = 0 AS is_unique, '' AS filter, string_agg(coalesce(column_name, expression), ',' ORDER BY seq_in_index) AS columns, '' AS include_cols,
  CASE WHEN bool_or(column_name IS NULL) THEN string_agg(CASE WHEN column_name IS NULL THEN 'true' ELSE 'false' END, ',' ORDER BY seq_in_index) ELSE '' END AS exprs,
  CASE WHEN max(coalesce(sub_part, 0)) > 0 THEN string_agg(coalesce(sub_part, 0)::VARCHAR, ',' ORDER BY seq_in_index) ELSE '' END AS prefixes
  FROM my_statistics WHERE index_name <> 'PRIMARY' {} GROUP BY table_name, index_name, non_unique"""
SQL = {
    "list_tables": "SELECT table_name FROM tables WHERE table_schema = 'lib' AND table_type = 'BASE TABLE'",
    "pg_columns_12": _pg_columns(f"({_SEQUENCE} OR is_identity = 'YES')", "(is_generated = 'ALWAYS')"),
    "pg_columns_10": _pg_columns(f"({_SEQUENCE} OR is_identity = 'YES')", "false"),
    "pg_columns_9": _pg_columns(f"({_SEQUENCE})", "false"),
    "mysql_columns": f"""SELECT {_COLUMNS.replace("data_type", "CASE WHEN column_type = 'tinyint(1)' THEN column_type ELSE data_type END AS data_type")}, coalesce(extra, '') = 'auto_increment' AS is_identity, CASE WHEN extra IS NULL OR extra NOT IN ('auto_increment', 'STORED GENERATED', 'VIRTUAL GENERATED') THEN column_default END AS default_expr,
  coalesce(extra, '') IN ('STORED GENERATED', 'VIRTUAL GENERATED') AS is_computed, CASE WHEN extra IN ('STORED GENERATED', 'VIRTUAL GENERATED') THEN generation_expression END AS computed_expr, coalesce(extra, '') = 'STORED GENERATED' AS computed_persisted, column_type ILIKE '%unsigned%' AS is_unsigned,
  CASE WHEN contains(extra, 'on update') THEN split_part(extra, 'on update ', 2) ELSE '' END AS on_update, CASE WHEN data_type = 'enum' THEN 'a,it''s,b''c, d' ELSE '' END AS enum_values FROM columns""",
    "mssql_computed_columns": f"""SELECT {_COLUMNS}, is_identity = 1 AS is_identity, CASE WHEN is_identity = 0 THEN column_default END AS default_expr, d.definition IS NOT NULL AS is_computed, d.definition AS computed_expr, coalesce(d.is_persisted = 1, false) AS computed_persisted
  FROM ms_list l LEFT JOIN (SELECT t.name AS t, c.name AS c, definition, is_persisted FROM ms_computed JOIN ms_columns c USING (object_id, column_id) JOIN ms_tables t USING (object_id)) d ON l.table_name = d.t AND l.column_name = d.c""",
    "spatial_columns": "SELECT c.table_name, c.column_name, c.data_type, coalesce(s.subtype, '') AS subtype, coalesce(s.srid, 0) AS srid FROM columns c LEFT JOIN spatial s USING (table_name, column_name)",
    "pg_primary_keys": f"SELECT relname AS table_name, string_agg(attname, ',' ORDER BY place) AS columns FROM ({_UNNESTED} WHERE contype = 'p') k JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = k.mine JOIN pg_class c ON c.oid = k.conrelid GROUP BY relname",
    "mysql_primary_keys": "SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM my_usage WHERE constraint_name = 'PRIMARY' GROUP BY table_name",
    "mssql_primary_keys": "SELECT t.name AS table_name, string_agg(c.name, ',' ORDER BY key_ordinal) AS columns FROM ms_indexes i JOIN ms_index_columns k USING (object_id, index_id) JOIN ms_columns c USING (object_id, column_id) JOIN ms_tables t USING (object_id) WHERE is_primary_key = 1 GROUP BY t.name",
    "pg_indexes": """WITH p AS (SELECT *, unnest(string_split(indkey, ' '))::INT AS attnum, unnest(range(len(string_split(indkey, ' ')))) AS place FROM pg_index WHERE NOT indisprimary),
n AS (SELECT p.*, t.relname AS table_name, x.relname AS index_name, attname, coalesce(attname, string_split(expressions, ';')[count(*) FILTER (p.attnum = 0) OVER (PARTITION BY indexrelid ORDER BY place)]) AS part
  FROM p LEFT JOIN pg_attribute a ON a.attrelid = p.indrelid AND a.attnum = p.attnum JOIN pg_class t ON t.oid = p.indrelid JOIN pg_class x ON x.oid = p.indexrelid)
SELECT table_name, index_name, indisunique AS is_unique, coalesce(predicate, '') AS filter, string_agg(part, ',' ORDER BY place) FILTER (place < indnkeyatts) AS columns, coalesce(string_agg(part, ',' ORDER BY place) FILTER (place >= indnkeyatts), '') AS include_cols,
  CASE WHEN bool_or(attnum = 0) THEN string_agg((attnum = 0)::VARCHAR, ',' ORDER BY place) ELSE '' END AS exprs, '' AS prefixes FROM n GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY table_name, index_name, indisunique, predicate"),
    "mysql_indexes": _MY_INDEX.format(""),
    "mysql_indexes_old": _MY_INDEX.format("AND column_name IS NOT NULL"),
    "mssql_indexes": """SELECT t.name AS table_name, i.name AS index_name, i.is_unique = 1 AS is_unique, coalesce(filter_definition, '') AS filter, string_agg(c.name, ',' ORDER BY key_ordinal) FILTER (is_included_column = 0) AS columns,
  coalesce(string_agg(c.name, ',' ORDER BY column_id) FILTER (is_included_column = 1), '') AS include_cols, '' AS exprs, '' AS prefixes
  FROM ms_indexes i JOIN ms_index_columns k USING (object_id, index_id) JOIN ms_columns c USING (object_id, column_id) JOIN ms_tables t USING (object_id) WHERE is_primary_key = 0 GROUP BY t.name, i.name, i.is_unique, filter_definition""",
    "pg_foreign_keys": f"""SELECT t.relname AS table_name, conname AS fk_name, r.relname AS ref_table, {_RULE.format("confdeltype")} AS on_delete, {_RULE.format("confupdtype")} AS on_update, string_agg(a.attname, ',' ORDER BY place) AS columns, string_agg(b.attname, ',' ORDER BY place) AS ref_columns
  FROM ({_UNNESTED} WHERE contype = 'f') k JOIN pg_attribute a ON a.attrelid = conrelid AND a.attnum = mine JOIN pg_attribute b ON b.attrelid = confrelid AND b.attnum = theirs JOIN pg_class t ON t.oid = conrelid JOIN pg_class r ON r.oid = confrelid GROUP BY t.relname, conname, r.relname, confdeltype, confupdtype""",
    "mysql_foreign_keys": "SELECT table_name, constraint_name AS fk_name, referenced_table_name AS ref_table, delete_rule AS on_delete, update_rule AS on_update, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns, string_agg(referenced_column_name, ',' ORDER BY ordinal_position) AS ref_columns FROM my_usage JOIN my_references USING (constraint_name, table_name) WHERE referenced_table_name IS NOT NULL GROUP BY table_name, constraint_name, referenced_table_name, delete_rule, update_rule",
    "mssql_foreign_keys": """SELECT t.name AS table_name, fk_name, r.name AS ref_table, replace(delete_action, '_', ' ') AS on_delete, replace(update_action, '_', ' ') AS on_update, string_agg(a.name, ',' ORDER BY constraint_column_id) AS columns, string_agg(b.name, ',' ORDER BY constraint_column_id) AS ref_columns
  FROM ms_keys JOIN ms_key_columns k USING (constraint_object_id) JOIN ms_columns a ON a.object_id = k.parent_object_id AND a.column_id = k.parent_column_id JOIN ms_columns b ON b.object_id = k.referenced_object_id AND b.column_id = k.referenced_column_id
  JOIN ms_tables t ON t.object_id = k.parent_object_id JOIN ms_tables r ON r.object_id = k.referenced_object_id GROUP BY t.name, fk_name, r.name, delete_action, update_action""",
    "pg_checks": "SELECT relname AS table_name, conname AS check_name, consrc AS definition FROM pg_constraint JOIN pg_class ON oid = conrelid WHERE contype = 'c'",
    "mysql_checks": "SELECT table_name, constraint_name AS check_name, check_clause AS definition FROM my_checks JOIN my_constraints USING (constraint_schema, constraint_name)",
    "mssql_checks": "SELECT t.name AS table_name, c.name AS check_name, definition FROM ms_checks c JOIN ms_tables t USING (object_id)",
    "pg_row_size": "SELECT relname AS table_name, bytes // live AS avg_bytes FROM pg_class WHERE live > 0",
    "mssql_row_size": "SELECT table_name, greatest(200, CASE WHEN sum(row_count) > 0 THEN sum(pages) * 8192 // sum(row_count) ELSE 0 END)::BIGINT AS row_bytes FROM ms_partitions GROUP BY table_name",
    "table_exists": "SELECT DISTINCT table_name, lower(table_name) IN (SELECT lower(table_name) FROM columns) AS is_there FROM probes",
    "index_exists": "SELECT table_name, index_name, (lower(table_name), lower(index_name)) IN (SELECT (lower(table_name), lower(index_name)) FROM my_statistics) AS is_there FROM probes",
    "foreign_key_exists": "SELECT DISTINCT u.table_name, u.constraint_name, EXISTS (FROM my_references r WHERE r.table_name = u.table_name AND r.constraint_name = u.constraint_name) AS is_there FROM my_usage u",
    "check_exists": "SELECT constraint_schema, constraint_name, EXISTS (FROM my_constraints t WHERE t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name) AS is_there FROM my_checks c",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from larkspur.catalog_sql import _COUNTS

    def with_relations(sql: str) -> str:
        used = [f"{n} AS (SELECT * FROM (VALUES {v}) AS t({c}))" if n == "fast_counts" else f"{n} AS {estate.relation(f'VALUES {v}', c.split(', '), **_how(n))}" for n, (c, v) in RELATIONS.items() if n in sql]
        return f"WITH {', '.join(used)} " + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else sql)

    out = {name: with_relations(sql) for name, sql in SQL.items()}
    out["row_count_fallback"] = with_relations(f"SELECT table_name, CASE WHEN fast > 0 THEN fast ELSE row_count END AS row_count FROM {_COUNTS} LEFT JOIN fast_counts USING (table_name)")
    return out

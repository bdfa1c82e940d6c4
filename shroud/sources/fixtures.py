"""Derived inputs (see FIXTURES.md): each is one SELECT over the driver tables
that Spark SQL and DuckDB both run, so Spark queries and oracle SQL read the
same rows. Work grows with the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import deal, spread, table

F_TEXT = """select doc_id, source, lang, concat(text, ' ssn ', lpad(cast(doc_id % 1000 as string), 3, '0'), '-', lpad(cast(doc_id % 100 as string), 2, '0'), '-', lpad(cast(doc_id % 10000 as string), 4, '0'), ' Password: p', cast(doc_id as string), ' select customer_id, Email from t') as text from documents"""

F_CHAT = """select conv_id, turn, role, concat(text, case when turn % 2 = 0 then concat(' token=', cast(conv_id as string), '.x') else '' end, case when conv_id % 3 = 0 then ' 10.0.0.1' else '' end) as content, case when conv_id % 4 = 0 then cast(null as double) else (conv_id % 10) / 10.0 end as temperature from conversations"""

_LINE = "replace(replace(replace(replace(replace(text, chr(10), ' '), chr(34), ''), chr(39), ''), chr(92), ''), '=', ' ')"
F_CODE = f"""select concat('src/p', cast(doc_id % 10 as string), '/m', cast(doc_id as string), case when doc_id % 5 = 0 then '.sql' when doc_id % 7 = 0 then '.js' else '.py' end) as path,
 case when doc_id % 13 = 0 then cast(null as string) else concat_ws(chr(10), concat('# ', lang, ' module: ', {_LINE}), concat('import pandas as pd, os.path', case when doc_id % 3 = 0 then '  # for, tables' else '' end),
 concat('from p', cast((doc_id * 7) % 200 % 10 as string), '.m', cast((doc_id * 7) % 200 as string), ' import load, save'),
 case when doc_id % 4 = 1 then 'from typing import (' end, case when doc_id % 4 = 1 then '    Any,  # of, all' end, case when doc_id % 4 = 1 then '    Dict)' end, '',
 concat('class C', cast(doc_id as string), case when doc_id % 3 = 0 then '(Base, Generic[T, U], metaclass=Meta):' else '(Base):' end), case when doc_id % 6 = 2 then '    {chr(34) * 3}Rows.{chr(34) * 3}' end, '    limit = 1',
 case when doc_id % 4 = 0 then '    @property' end, '    def run(self, n, *rest, key=None):', case when doc_id % 6 = 1 then '        {chr(34) * 3}Runs it.{chr(34) * 3}' end, '        return n',
 case when doc_id % 2 = 0 then concat('@app.route(', chr(34), '/x/', source, chr(34), ')') end,
 concat('def f', cast(doc_id as string), case when doc_id % 3 = 1 then '(a: Dict[str, int], b=(1, 2), *, c: str = None) -> Dict[str, int]:' else '(a, b=1):' end), case when doc_id % 4 = 3 then '    {chr(34) * 3}Reads and deletes.{chr(34) * 3}' end,
 concat('    df = pd.read_csv(', chr(34), source, chr(34), ')'), concat('    q = ', chr(34), 'SELECT a, b FROM ', source, ' WHERE n > 1 ', {_LINE}, chr(34)), '    if a:', '        cur.execute(q)', '    elif b:', concat('        cur.execute(', chr(34), 'DELETE FROM ', lang, chr(34), ')'),
 '    x = load(q).head(3)', '    return [x for x in df]') end as content from documents"""

F_DDL = """select cast(c_custkey as string) as script_id, concat('CREATE TABLE ent', cast(c_custkey as string), ' (id BIGINT PRIMARY KEY, name VARCHAR(', cast(20 + c_nationkey as string), ') NOT NULL DEFAULT ', chr(39), 'a;b', chr(39), ', amt DECIMAL(10,2), grp_id INT, CONSTRAINT ck CHECK (amt > 0)); CREATE TABLE grp (id INT PRIMARY KEY, label TEXT);', chr(10), 'CREATE UNIQUE INDEX ix ON ent', cast(c_custkey as string), ' (name); ALTER TABLE ent', cast(c_custkey as string), ' ADD COLUMN note TEXT; ', case when c_custkey % 7 = 0 then 'DROP TABLE grp;' else 'TRUNCATE TABLE grp' end) as content from customer"""

F_LOG = """select user_id % 10 as script_id, event_id as seq,
 case (event_id + user_id) % 16 when 0 then 'drop_table' when 1 then 'truncate' when 2 then 'create_schema' when 3 then 'rename_column' when 4 then 'drop_column' when 5 then 'set_default' when 6 then 'drop_default' when 7 then 'set_not_null' when 8 then 'drop_not_null' when 9 then 'add_constraint' when 10 then 'drop_constraint' when 11 then 'create_index' when 12 then 'create_table' when 13 then 'create_table' else 'add_column' end as op,
 concat('t', cast(user_id % 20 as string)) as table_name,
 concat('c', cast(event_id % 6 as string)) as column_name,
 case when (event_id + user_id) % 16 = 3 then concat('c', cast((event_id + 1) % 6 as string)) else concat('v', cast(cast(floor(value) as int) % 5 as string)) end as value,
 case event_type when 'signup' then 'PRIMARY KEY' when 'purchase' then 'FOREIGN KEY' when 'error' then 'FOREIGN KEY ON DELETE CASCADE' when 'click' then 'UNIQUE' else 'CHECK' end as constraint_type,
 concat('t', cast((user_id + 10) % 20 as string)) as reference_table
from events"""

F_CAT_TABLES = """select c_custkey as pos, concat('ent', cast(c_custkey as string), case c_custkey % 3 when 0 then '' when 1 then 's' else 'es' end) as table_name, 'id' as column_name, c_custkey % 5 <> 0 as is_primary_key from customer"""

F_CAT_COLUMNS = """select concat('fact', cast(o_orderkey % 100 as string)) as table_name, o_orderkey as ordinal, concat('Ent', cast(o_custkey as string), '_id') as column_name, o_orderkey % 11 = 0 as is_foreign_key from orders"""

# Ours (not in FIXTURES.md): DDL with views, materialized views, DROP VIEW,
# CREATE SCHEMA, RENAME COLUMN and an FK with ON DELETE, one script per customer.
F_VIEWS = """select cast(c_custkey as string) as script_id, concat('CREATE TABLE acct', cast(c_custkey as string), ' (id INT PRIMARY KEY, owner_id INT, bal DOUBLE);', ' CREATE VIEW v', cast(c_custkey as string), ' (id, bal) AS SELECT id, bal FROM acct', cast(c_custkey as string), ';', ' CREATE MATERIALIZED VIEW mv', cast(c_custkey as string), ' AS SELECT 1;', case when c_custkey % 3 = 0 then concat(' DROP VIEW v', cast(c_custkey as string), ';') else '' end, ' CREATE SCHEMA s', cast(c_nationkey as string), ';', ' CREATE TABLE owner (owner_id INT PRIMARY KEY, name VARCHAR(', cast(10 + c_nationkey as string), '));', case when c_custkey % 5 = 0 then ' ALTER TABLE owner RENAME COLUMN name TO full_name;' else '' end, case when c_custkey % 4 = 0 then concat(' ALTER TABLE acct', cast(c_custkey as string), ' ADD CONSTRAINT fk_owner FOREIGN KEY (owner_id) REFERENCES owner (owner_id) ON DELETE CASCADE;') else '' end) as content from customer"""

# Ours: DDL as dump tools write it. One script per document: comments, backticks,
# index items, composite keys, nested CHECKs, definitions over several lines,
# PARTITION BY, CREATE TABLE AS, and an INSERT of the document's whole text,
# three times over. Column names of all three PII groups occur.
F_DUMP = """select cast(doc_id as string) as script_id, concat('-- dump of ', source, '; not a statement', chr(10),
 'CREATE TABLE `users', cast(doc_id as string), '` (', chr(10), '  `user_id` BIGINT NOT NULL, -- the key', chr(10), '  email VARCHAR(', cast(doc_id % 200 as string), ')', chr(10), '    DEFAULT ', chr(39), 'a;b, (c', chr(39), ',', chr(10),
 '  /* ', lang, ', ; */ salary DECIMAL(10, 2) CHECK (salary IS NOT NULL),', chr(10), '  zip_code INT,', chr(10), '  org INT, grp INT,', chr(10),
 '  PRIMARY KEY (`user_id`, org),', chr(10), '  UNIQUE KEY uq_mail (email),', chr(10), '  KEY ix (zip_code),', chr(10),
 '  CONSTRAINT fk_', lang, ' FOREIGN KEY (org, grp) REFERENCES orgs (id, grp) ON DELETE ', case when doc_id % 2 = 0 then 'CASCADE' else 'set  null' end, ' ON UPDATE NO ACTION,', chr(10),
 '  CONSTRAINT ck CHECK (((salary > 0) AND ((zip_code < 99999) OR (lower(trim(email)) <> ', chr(39), 'x)', chr(39), '))))', chr(10), ') ENGINE=x PARTITION BY RANGE (zip_code);', chr(10),
 'CREATE TABLE copy', cast(doc_id as string), ' AS SELECT * FROM users;', chr(10), '# done', chr(10),
 'INSERT INTO notes VALUES (', chr(39), replace(replace(concat(text, text, text), chr(92), ''), chr(39), ''), chr(39), ');',
 'SET x = 1') as content from documents"""

# Ours: references between tables, one per customer: trees of some depth, cycles of
# three tables, tables that refer to themselves, and tables below cycles.
F_REFS = """select concat('t', cast(c_custkey as string)) as child, concat('t', cast(case when c_custkey % 10 = 0 then c_custkey + 1 when c_custkey % 10 = 1 then c_custkey + 1 when c_custkey % 10 = 2 then c_custkey - 2 when c_custkey % 7 = 0 then c_custkey when c_custkey % 5 = 3 then c_custkey - c_custkey % 10 + 4 else cast(floor(c_custkey / 3) as bigint) end as string)) as parent from customer"""

FIXTURES = {
    "f_refs": (F_REFS, ["customer"]),
    "f_text": (F_TEXT, ["documents"]),
    "f_chat": (F_CHAT, ["conversations"]),
    "f_code": (F_CODE, ["documents"]),
    "f_ddl": (F_DDL, ["customer"]),
    "f_log": (F_LOG, ["events"]),
    "f_cat_tables": (F_CAT_TABLES, ["customer"]),
    "f_cat_columns": (F_CAT_COLUMNS, ["orders"]),
    "f_views": (F_VIEWS, ["customer"]),
    "f_dump": (F_DUMP, ["documents"]),
}


#: Inputs whose short rows grow into whole scripts: a file that one task reads in a
#: moment is long work for that task. Their table's rows are dealt before they grow.
GROWN = {"f_ddl", "f_views"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run the fixture's SELECT with its table bound as a DataFrame argument
    (``spark.sql(query, **dfs)``): no temp view is created or replaced in the
    caller's session."""
    sql, deps = FIXTURES[name]
    bound = sql
    for t in deps:
        bound = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", bound)
    tables = {t: table(spark, sf_dir, t) for t in deps}
    if name in GROWN:
        return spark.sql(bound, **{t: deal(df) for t, df in tables.items()})
    return spread(spark.sql(bound, **tables))


def cte(name: str) -> str:
    """The fixture as a DuckDB CTE: ``name AS (select ...)``."""
    return f"{name} AS ({FIXTURES[name][0]})"

"""The test tables read as the domain: committees are customers, meetings orders, agenda items line items, papers parts.

Every table is one SELECT in SQL that Spark and other engines read alike; the checks reuse the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.plans.api import Council

TODAY = "1998-06-15"

DOMAIN = {
    "districts": """select cast(n_nationkey as bigint) as id, n_name as name, '21-0' || cast(n_nationkey % 3 as string) as first_number, cast(20 + n_nationkey as int) as oldest_doc_id,
        case when n_nationkey % 4 = 0 then null else n_nationkey % 5 end as ord, cast(53 + n_nationkey as double) as ne_lat, cast(10 + n_nationkey * 2 as double) as ne_lng, cast(n_nationkey as double) + 52 + cast(0.5 as double) as sw_lat, cast(9 + n_nationkey as double) as sw_lng from {nation}""",
    "committees": """select c_custkey as id, cast(c_nationkey as bigint) as district_id, c_name as name, case when c_custkey % 7 = 0 then null else cast(c_custkey % 50 as int) end as ord,
        c_mktsegment <> 'BUILDING' as public, c_acctbal < 0 as inactive, case when c_custkey % 3 = 0 then null else cast(3600 + c_custkey % 100 as int) end as average_duration from {customer}""",
    "meetings": """select o_orderkey as id, cast(o_custkey % 25 as bigint) as district_id, o_custkey as committee_id, cast(o_orderdate as date) as date,
        case when o_orderstatus = 'P' then null else cast(61200 + (o_orderkey % 7) * 900 as int) end as start_sec,
        case when o_orderstatus = 'P' or o_orderkey % 6 = 0 then null else cast(64800 + (o_orderkey % 11) * 300 as int) end as end_sec,
        case when o_orderkey % 9 = 0 then null else 'Sitzung ' || o_orderpriority end as title, o_orderpriority as room, 'Rathaus ' || cast(o_orderkey % 13 as string) as location from {orders}""",
    "agenda_items": """select l_orderkey * 10 + l_linenumber as id, l_orderkey as meeting_id, l_partkey as document_id, case when l_returnflag = 'N' and l_linenumber % 2 = 0 then null else cast(l_suppkey as int) end as ext_id,
        'Ö ' || cast(l_linenumber + 6 as string) || case when l_linenumber % 3 = 0 then '.1' else '' end as number, 'Punkt ' || cast(l_linenumber as string) as title,
        case when l_returnflag = 'R' then 'ungeändert beschlossen' when l_linestatus = 'O' then 'vertagt' when l_linenumber = 1 then 'abgelehnt' end as decision,
        case when l_returnflag = 'R' then '<p>Beratung zu ' || cast(l_partkey as string) || ' ' || l_linestatus || '</p>' end as minutes,
        case when l_returnflag = 'A' then 'Beschlossen <b>' || l_returnflag || '</b>' end as result, cast(l_quantity as int) as word_count from {lineitem}""",
    "documents": """select p_partkey as id, cast(p_partkey % 25 as bigint) as district_id, cast(p_partkey + 100 as int) as ext_id,
        '21-' || lpad(cast(cast(floor(p_partkey / 100) as bigint) as string), 4, '0') || case when p_partkey % 100 < 25 then '' when p_partkey % 100 < 50 then '.1' when p_partkey % 100 < 75 then '.1.1' else '.2' end as number,
        case when p_size % 17 = 0 then null else p_name end as title,
        case p_size % 6 when 0 then 'Antrag' when 1 then 'Kleine Anfrage öffentlich' when 2 then 'Große Anfrage öffentlich' when 3 then 'Auskunftsersuchen' when 4 then 'Interfraktioneller antrag' end as kind,
        p_brand as author, case when p_size % 13 = 0 then null else p_name || ' ' || p_type end as full_text, '<p>' || p_type || '</p>' as content, cast(null as string) as resolution, cast(null as string) as attached, cast(null as timestamp) as created_at, cast(null as timestamp) as updated_at,
        case when p_size = 1 then null else p_size >= 45 end as non_public from {part}""",
    "parties": """select cast(r_regionkey as bigint) as id, r_name as name, r_regionkey = 4 as inactive from {region}""",
    "members": """select s_suppkey as id, cast(s_nationkey as bigint) as district_id, case when s_suppkey % 11 = 0 then null else cast(s_nationkey % 5 as bigint) end as party_id, s_name as name,
        case when s_suppkey % 5 = 0 then 'zubenannte/r Bürger/in' when s_suppkey % 7 = 0 then null else 'Mitglied' end as kind, s_acctbal < 0 as inactive from {supplier}""",
    "memberships": """select c_custkey as committee_id, s_suppkey as member_id, 'Mitglied' as role, s_suppkey % 13 = 0 as inactive from {customer} join {supplier} on c_nationkey = s_nationkey where c_custkey % 4 = s_suppkey % 4""",
    "attachments": """select cast(l_orderkey * 10 + l_linenumber as bigint) as id, case when l_linenumber = 7 then 'Meeting' else 'Document' end as attachable_type, l_partkey as attachable_id, 'Anlage ' || cast(l_linenumber as string) as name,
        'red attachment ' || l_returnflag as content from {lineitem} where l_linenumber >= 6""",
    "locations": """select s_suppkey as id, cast(s_nationkey as bigint) as district_id, s_name as name, cast(52 + s_nationkey as double) + cast(s_suppkey % 40 as double) / 16 as latitude, cast(9 + s_nationkey as double) + cast(s_suppkey % 30 as double) / 8 as longitude from {supplier}""",
    "document_locations": """select distinct l_partkey as document_id, l_suppkey as location_id from {lineitem}""",
}


#: The test tables' schemas, so that none is inferred from files.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet")


class Analogue(Council):
    """The domain over the tables below sf_dir; a table is made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._made:
            sql = DOMAIN[name]
            used = [t for t in RAW if "{" + t + "}" in sql]
            self._made[name] = self.spark.sql(sql, **{t: raw(self.spark, self.sf_dir, t) for t in used})
        return self._made[name]


for _name in DOMAIN:
    setattr(Analogue, "all_documents" if _name == "documents" else _name, property(lambda self, n=_name: self._table(n)))


def council(spark: SparkSession, sf_dir: str) -> Council:
    """The domain over the tables below sf_dir."""
    return Analogue(spark, sf_dir)


def with_sql(*names: str) -> str:
    """The named tables as the start of a query in SQL; documents are those that the public sees."""
    parts = []
    for n in names:
        sql = DOMAIN[n]
        for t in RAW:
            sql = sql.replace("{" + t + "}", f"main.{t}")
        if n == "documents":
            parts.append(f"all_documents as ({sql})")
            sql = "select * from all_documents where not non_public"
        parts.append(f"{n} as ({sql})")
    return "with " + ",\n".join(parts) + "\n"

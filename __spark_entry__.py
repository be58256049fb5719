"""

``entry(spark)`` runs the flagship job (wait of every read for the next
mount of its tape) on sf0.001.  ``queries()`` registers one DataFrame per
operator / job (see ``mountwait.plans.suite``); ``oracle_sql()`` gives the
same result as DuckDB SQL over the driver's tables, so that both can be
compared row for row.  The adapters from driver tables to archive tables
appear on both sides: ``mountwait.sources.testdata`` and the CTEs below.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# The package sits next to this file; make it importable however this file
# is loaded (by path, from another working directory).
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from mountwait.plans import suite  # noqa: E402
from mountwait.session import apply_core_conf  # noqa: E402

# The operators for training-data pipelines are optional: without their
# subpackage the other queries stay as they are.  Any other failed import is an error.
try:
    from mountwait.llm import queries as llm_queries  # noqa: E402
    import corpus_pipeline  # noqa: E402
except ImportError as missing:
    if missing.name not in ("mountwait.llm", "mountwait.llm.queries", "corpus_pipeline"):
        raise
    llm_queries = corpus_pipeline = None

ENTRY_SF_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: read waits on sf0.001 (every read, matched or not)."""
    apply_core_conf(spark)
    return suite.read_waits(spark, ENTRY_SF_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_core_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    out = {name: wrap(fn) for name, fn in suite.SUITE.items()}
    if llm_queries is not None:
        out |= {name: wrap(fn) for name, fn in llm_queries.QUERIES.items()}
        out["pipeline"] = wrap(corpus_pipeline.run)
    return out


# ----------------------------------------------------------------- oracle SQL
# Adapter CTEs (the same mapping as mountwait/sources/testdata.py).

_FAMILY = ("case user_id % 5 when 0 then 'fam-a' when 1 then 'fam/a' "
           "when 2 then 'fam_b' when 3 then 'fam-c' end")


def _bfid(site: str, ts: str, ident: str) -> str:
    return (f"{site} || lpad(cast(floor(epoch({ts})) as bigint)::varchar, 10, '0') "
            f"|| lpad({ident}::varchar, 6, '0')")


_CTE = {
    "vol": f"""vol as (select distinct user_id as id, 'V' || user_id as label,
        {_FAMILY} as file_family from events)""",
    "fam": """fam as (select distinct label, file_family from vol where label is not null)""",
    "tm": """tm as (select event_id as tapemount_id, 'V' || user_id as volume, ts as start,
        case when event_id % 7 <> 0 then ts + to_minutes(cast(1 + event_id % 600 as integer)) end as finish,
        (case when event_type = 'error' then 0 else 1 + event_id % 5 end)::BIGINT as writes
        from events where event_type in ('purchase', 'signup', 'error'))""",
    "fm": """fm as (select t.tapemount_id, t.volume, t.start, t.finish, t.writes, f.file_family
        from tm t left join fam f on f.label = t.volume where t.writes > 0)""",
    "rd": f"""rd as (select event_id as sfbr_id,
        {_bfid("case when event_id % 11 = 0 then 'XXXX' else 'CDMS' end", "ts", "event_id")} as bfid,
        ts as datestamp, {_FAMILY} as file_family, 'V' || user_id as volume,
        case when event_id % 3 <> 0 then 'V' || (user_id + 1) end as migrated_volume
        from events where event_type = 'view')""",
    "st": f"""st as (select event_id as storageinfo_id,
        case when event_id % 2 = 0 then 'store' else 'restore' end as action,
        case when event_id % 5 = 0 then 1 else 0 end as errorcode,
        case when event_id % 17 = 0 then null else event_id % 13 = 0 end as updated,
        'P' || event_id as pnfsid, {_bfid("'CDMS'", "ts", "event_id")} as bfid,
        ts as datestamp, {_FAMILY} as file_family,
        case when event_id % 3 <> 0 then 'V' || user_id end as volume
        from events where event_type = 'click')""",
    "fl": f"""fl as (select o_orderkey as id, 'P' || o_orderkey as pnfsid,
        case when o_orderkey % 4 <> 0 then o_custkey end as package_id,
        o_orderpriority as original_library,
        {_bfid("'CDMS'", "o_orderdate", "o_orderkey")} as bfid,
        'V' || (o_custkey % 200) as volume from orders)""",
    "pk": """pk as (select * from fl where package_id is not null)""",
    "bi": """bi as (select (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as billinginfo_id,
        'P' || l_orderkey as pnfsid, l_shipdate as datestamp from lineitem)""",
}
_DEPS = {"fam": ["vol"], "fm": ["tm", "fam"], "pk": ["fl"]}


def _with(*names: str, extra: str = "") -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    parts = [_CTE[n] for n in order] + ([extra] if extra else [])
    return "with " + ",\n".join(parts) + "\n"


def _age(a: str, b: str, prefix: str = "age_") -> str:
    ag = f"age({a}, {b})"
    return (f"(date_part('year', {ag}) * 12 + date_part('month', {ag}))::INTEGER as {prefix}months, "
            f"date_part('day', {ag})::INTEGER as {prefix}days, "
            f"(date_part('hour', {ag})::BIGINT * 3600000000 + date_part('minute', {ag})::BIGINT * 60000000"
            f" + date_part('microseconds', {ag})::BIGINT) as {prefix}us")


def _wait(a: str, b: str) -> str:
    return f"(epoch_us({a}) - epoch_us({b})) as wait_us, {_age(a, b)}"


_BFID_OK = "substr(bfid, 1, 4) = 'CDMS' and regexp_full_match(substr(bfid, 5, 10), '[0-9]{10}')"
_BFID_T = "make_timestamp(cast(substr(bfid, 5, 10) as bigint) * 1000000)"
_NOT_DONE = "updated is not null and not updated"


def _first_mount_by_volume() -> str:
    return "mv as (select volume, start, min(tapemount_id) as tapemount_id from tm group by all)"


def _first_mount_by_family() -> str:
    return ("mf as (select file_family, start, min(tapemount_id) as tapemount_id from fm "
            "where file_family is not null group by all)")


def _read_wait_sql(vol_col: str, id_out: str) -> str:
    return _with("tm", "rd", extra=_first_mount_by_volume() + f""",
    j as (select r.sfbr_id, r.datestamp,
            case when m.start < r.datestamp + interval 1 day then m.start end as mstart,
            case when m.start < r.datestamp + interval 1 day then m.tapemount_id end as mid
          from rd r asof left join mv m on r.{vol_col} = m.volume and r.datestamp < m.start)""") + f"""
select sfbr_id, mid as {id_out}, {_wait("mstart", "datestamp")} from j"""


_ORACLE = {
    "scan_table": _with("bi") + """
select count(*)::BIGINT as row_count, count(pnfsid)::BIGINT as n_pnfsid,
       min(datestamp) as min_datestamp, max(datestamp) as max_datestamp,
       sum(billinginfo_id % 1000003)::BIGINT as sum_id_mod from bi""",
    "id_range_shards": _with("fl", extra="mx as (select max(id) as m from fl)") + """
select cast(floor(id / ceil((m + 1) / 10.0)) as INTEGER) as shard, count(*)::BIGINT as n_rows,
       min(id) as min_id, max(id) as max_id from fl, mx group by 1""",
    "depth_shards": f"""
select s::INTEGER as shard, true as even, true as ascending, (select count(*) from orders)::BIGINT as n_total
from range(10) t(s)""",
    "packaged_files": _with("pk") + "select * from pk",
    "package_reads": _with("pk", "bi") + "select * from bi join pk using (pnfsid)",
    "small_file_reads": _with("pk", "bi", "fam") + """
select p.billinginfo_id as sfbr_id, p.pnfsid, p.bfid, p.datestamp, f.file_family,
       cast(null as varchar) as volume, p.volume as migrated_volume
from (select * from bi join pk using (pnfsid)) p left join fam f on f.label = p.volume""",
    "small_file_stores": _with("st", "pk", "fam") + """
select s.storageinfo_id, s.pnfsid, s.action, s.volume, coalesce(s.file_family, f.file_family) as file_family
from st s join (select pnfsid, min(volume) as tape from pk group by 1) p using (pnfsid)
left join fam f on f.label = p.tape""",
    "filtered_mounts": _with("fm") + "select * from fm",
    "mounts_with_family": _with("tm", "fam") + """
select t.*, f.file_family from tm t join fam f on f.label = t.volume
where t.writes > 0 and f.file_family is not null""",
    "library_counts": _with("fl") + """
select original_library, count(*)::BIGINT as n_files from fl group by 1""",
    "family_min_id": _with("vol") + "select file_family, min(id) as min_id from vol group by 1",
    "family_labels": _with("vol") + "select file_family, label from vol where file_family is not null",
    "family_key": _with("vol") + """
select file_family, 'volume_labels_ff_' || regexp_replace(file_family, '[-/]', '_', 'g') as family_key
from (select distinct file_family from vol where file_family is not null)""",
    "family_key_collisions": _with("vol") + """
select family_key, count(*)::BIGINT as n_families from (
  select distinct file_family, 'volume_labels_ff_' || regexp_replace(file_family, '[-/]', '_', 'g') as family_key
  from vol where file_family is not null) group by 1 having count(*) > 1""",
    "eligible_stores": _with("st") + f"""
select storageinfo_id, action, coalesce(file_family is not null and action is not null
       and datestamp is not null and pnfsid is not null and storageinfo_id is not null
       and {_NOT_DONE} and action = 'store', false) as eligible_store from st""",
    "eligible_restores": _with("st") + f"""
select storageinfo_id, action,
  coalesce(action is not null and errorcode is not null and storageinfo_id is not null and {_NOT_DONE}
           and action = 'restore' and errorcode = 0 and datestamp is not null and volume is not null,
           false) as eligible_restore_wait,
  coalesce(action is not null and errorcode is not null and storageinfo_id is not null and {_NOT_DONE}
           and action = 'restore' and errorcode = 0 and bfid is not null and file_family is not null
           and substr(bfid, 1, 4) = 'CDMS', false) as eligible_restore_volume
from st""",
    "bfid_parse": _with("rd") + """
select sfbr_id, bfid, coalesce(substr(bfid, 1, 4) = 'CDMS', false) as site_ok,
       case when regexp_full_match(substr(bfid, 5, 10), '[0-9]{10}')
            then cast(substr(bfid, 5, 10) as bigint) end as bfid_epoch,
       coalesce(substr(bfid, 1, 4) = 'CDMS' and regexp_full_match(substr(bfid, 5, 10), '[0-9]{10}'),
                false) as bfid_valid
from rd""",
    "bfid_window": _with("rd") + f"""
select sfbr_id, {_BFID_T} as bfid_time, {_BFID_T} + interval 8640000 second as window_end
from rd where {_BFID_OK}""",
    "age_parts": f"""
select e.event_id, {_wait("e.ts", "o.ts")}
from events e left join (select user_id, min(ts) as ts from events group by 1) o using (user_id)""",
    "age_parts_dates": f"""
select l.l_orderkey, l.l_linenumber, {_age("l.l_shipdate", "o.o_orderdate", "ship_")},
       {_age("o.o_orderdate", "l.l_shipdate", "back_")}
from lineitem l join orders o on o.o_orderkey = l.l_orderkey""",
    "asof_next": """
with r as (select event_id, user_id, ts from events where event_type = 'view'),
m as (select user_id, ts as m_ts, min(event_id) as m_event_id from events
      where event_type = 'purchase' group by all)
select r.event_id,
       case when m.m_ts < r.ts + interval 3 day then m.m_event_id end as next_event_id,
       case when m.m_ts < r.ts + interval 3 day then m.m_ts end as next_ts
from r asof left join m on r.user_id = m.user_id and r.ts < m.m_ts""",
    "asof_next_split": """
with r as (select event_id, case when event_id % 3 = 0 then -1 else user_id end as k, ts
           from events where event_type = 'view'),
m as (select case when event_id % 3 = 0 then -1 else user_id end as mk, ts as m_ts, min(event_id) as m_event_id
      from events where event_type = 'purchase' group by all)
select r.event_id,
       case when m.m_ts < r.ts + interval 3 day then m.m_event_id end as next_event_id,
       case when m.m_ts < r.ts + interval 3 day then m.m_ts end as next_ts
from r asof left join m on r.k = m.mk and r.ts < m.m_ts""",
    "asof_prev": """
with r as (select event_id, user_id, ts from events where event_type = 'view'),
m as (select user_id, ts as m_ts, min(event_id) as m_event_id from events
      where event_type = 'purchase' group by all)
select r.event_id,
       case when m.m_ts > r.ts - interval 3 day then m.m_event_id end as prev_event_id,
       case when m.m_ts > r.ts - interval 3 day then m.m_ts end as prev_ts
from r asof left join m on r.user_id = m.user_id and r.ts > m.m_ts""",
    "asof_next_ties": """
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, s_nationkey as nation
           from lineitem join supplier on s_suppkey = l_suppkey),
o as (select c_nationkey as o_nation, o_orderdate, min(o_orderkey) as o_orderkey
      from orders join customer on c_custkey = o_custkey group by all)
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
       case when o.o_orderdate < l.l_shipdate + interval 100 day then o.o_orderkey end as next_orderkey,
       case when o.o_orderdate < l.l_shipdate + interval 100 day then o.o_orderdate end as next_orderdate
from l asof left join o on l.nation = o.o_nation and l.l_shipdate < o.o_orderdate""",
    "asof_next_hot_key": """
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
                  case when l_orderkey % 3 = 0 then 99 else s_nationkey end as nation
           from lineitem join supplier on s_suppkey = l_suppkey),
o as (select case when o_orderkey % 3 = 0 then 99 else c_nationkey end as o_nation, o_orderdate,
             min(o_orderkey) as o_orderkey
      from orders join customer on c_custkey = o_custkey group by all)
select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
       case when o.o_orderdate < l.l_shipdate + interval 100 day then o.o_orderkey end as next_orderkey,
       case when o.o_orderdate < l.l_shipdate + interval 100 day then o.o_orderdate end as next_orderdate
from l asof left join o on l.nation = o.o_nation and l.l_shipdate < o.o_orderdate""",
    "asof_next_burst": """
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
                  case when l_orderkey % 2 = 0 then -1 else l_suppkey end as k,
                  case when l_orderkey % 2 = 0 then timestamp '2024-01-01' + to_microseconds(cast(
                    case when l_orderkey % 10 = 0 then 15000000
                         else (l_orderkey::BIGINT * 7919 + l_linenumber::BIGINT * 104729) % 30000000 end as bigint))
                  else l_shipdate::TIMESTAMP end as t from lineitem),
o as (select mk, mt, min(o_orderkey) as o_orderkey from (
        select o_orderkey, case when o_orderkey % 2 = 0 then -1 else o_custkey end as mk,
               case when o_orderkey % 2 = 0 then timestamp '2024-01-01' + to_microseconds(cast(
                 case when o_orderkey % 10 = 0 then 15000000
                      else (o_orderkey::BIGINT * 15485863) % 30000000 end as bigint))
               else o_orderdate::TIMESTAMP end as mt from orders) group by all)
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when mt < t + interval 100 day then o_orderkey end as next_orderkey,
       case when mt < t + interval 100 day then mt end as next_time
from l asof left join o on l.k = o.mk and l.t < o.mt""",
    "read_waits": _read_wait_sql("volume", "next_mount_id"),
    "read_waits_migrated": _read_wait_sql("migrated_volume", "migration_next_mount_id"),
    "previous_mount": _with("tm", "rd", extra=_first_mount_by_volume() + """,
    j as (select r.sfbr_id, r.datestamp, m.start as mstart, m.tapemount_id as mid
          from rd r asof left join mv m on r.migrated_volume = m.volume and r.datestamp > m.start),
    k as (select sfbr_id, datestamp, case when mstart > datestamp - interval 1 day then mid end as mid from j),
    f as (select k.sfbr_id, k.datestamp, case when t.finish is not null then k.mid end as mid,
                 t.finish from k left join tm t on t.tapemount_id = k.mid)""") + f"""
select sfbr_id, mid as previous_mount_100d_id,
       case when mid is not null then epoch_us(finish) - epoch_us(datestamp) end as wait_us,
       {_age("case when mid is not null then finish end", "datestamp")}
from f""",
    "read_host_volume": _with("rd", "fm", extra=_first_mount_by_family() + f""",
    r as (select sfbr_id, file_family, {_BFID_T} as bt from rd
          where bfid is not null and file_family is not null and sfbr_id is not null and {_BFID_OK}),
    j as (select r.sfbr_id, case when m.start < r.bt + interval 15 minute then m.tapemount_id end as mid
          from r asof left join mf m on r.file_family = m.file_family and r.bt < m.start),
    x as (select j.sfbr_id, t.volume as mvol from j join fm t on t.tapemount_id = j.mid)""") + """
select rd.sfbr_id, coalesce(x.mvol, rd.volume) as volume from rd left join x using (sfbr_id)""",
    "store_waits": _with("st", "fm", extra=_first_mount_by_family() + f""",
    e as (select storageinfo_id, datestamp, file_family from st
          where file_family is not null and action is not null and datestamp is not null
            and pnfsid is not null and storageinfo_id is not null and {_NOT_DONE} and action = 'store'),
    j as (select e.storageinfo_id,
                 case when m.start < e.datestamp + interval 15 minute then m.tapemount_id end as mid
          from e asof left join mf m on e.file_family = m.file_family and e.datestamp < m.start),
    x as (select j.storageinfo_id, j.mid, t.volume as mvol, t.start as mstart
          from j join fm t on t.tapemount_id = j.mid)""") + f"""
select st.storageinfo_id, coalesce(x.mvol, st.volume) as volume,
       case when x.mid is not null then true else st.updated end as updated,
       x.mstart as next_mount_time, x.mid as next_mount_id, {_wait("x.mstart", "st.datestamp")}
from st left join x using (storageinfo_id)""",
    "restore_host_volume": _with("st", "fm", extra=_first_mount_by_family() + f""",
    e as (select storageinfo_id, file_family, {_BFID_T} as bt from st
          where action is not null and errorcode is not null and storageinfo_id is not null and {_NOT_DONE}
            and action = 'restore' and errorcode = 0 and bfid is not null and file_family is not null
            and {_BFID_OK}),
    j as (select e.storageinfo_id, case when m.start < e.bt + interval 15 minute then m.tapemount_id end as mid
          from e asof left join mf m on e.file_family = m.file_family and e.bt < m.start),
    x as (select j.storageinfo_id, t.volume as mvol from j join fm t on t.tapemount_id = j.mid)""") + """
select st.storageinfo_id, case when x.mvol is not null then true else st.updated end as updated,
       coalesce(x.mvol, st.volume) as volume
from st left join x using (storageinfo_id)""",
    "restore_waits": _with("st", "tm", extra=_first_mount_by_volume() + f""",
    e as (select storageinfo_id, datestamp, volume from st
          where action is not null and errorcode is not null and storageinfo_id is not null and {_NOT_DONE}
            and action = 'restore' and errorcode = 0 and datestamp is not null and volume is not null),
    j as (select e.storageinfo_id,
                 case when m.start < e.datestamp + interval 1 day then m.start end as mstart
          from e asof left join mv m on e.volume = m.volume and e.datestamp < m.start)""") + f"""
select st.storageinfo_id, case when j.mstart is not null then true else st.updated end as updated,
       j.mstart as next_mount_time, {_wait("j.mstart", "st.datestamp")}
from st left join j using (storageinfo_id)""",
    "restore_chain": _with("st", "fm", "tm", extra=_first_mount_by_family() + ",\n"
                           + _first_mount_by_volume() + f""",
    e1 as (select storageinfo_id, file_family, {_BFID_T} as bt from st
           where action is not null and errorcode is not null and storageinfo_id is not null and {_NOT_DONE}
             and action = 'restore' and errorcode = 0 and bfid is not null
             and file_family is not null and {_BFID_OK}),
    j1 as (select e1.storageinfo_id,
                  case when m.start < e1.bt + interval 15 minute then m.tapemount_id end as mid
           from e1 asof left join mf m on e1.file_family = m.file_family and e1.bt < m.start),
    x1 as (select j1.storageinfo_id, t.volume as mvol from j1 join fm t on t.tapemount_id = j1.mid),
    s1 as (select st.storageinfo_id, st.action, st.errorcode, st.datestamp,
                  coalesce(x1.mvol, st.volume) as volume, x1.mvol is not null as volume_done
           from st left join x1 using (storageinfo_id)),
    e2 as (select storageinfo_id, datestamp, volume from s1
           where action is not null and errorcode is not null and storageinfo_id is not null
             and action = 'restore' and errorcode = 0 and datestamp is not null and volume is not null),
    j2 as (select e2.storageinfo_id,
                  case when m.start < e2.datestamp + interval 1 day then m.start end as mstart
           from e2 asof left join mv m on e2.volume = m.volume and e2.datestamp < m.start)""") + f"""
select s1.storageinfo_id, s1.volume, s1.volume_done, j2.mstart is not null as wait_done,
       j2.mstart as next_mount_time, {_wait("j2.mstart", "s1.datestamp")}
from s1 left join j2 using (storageinfo_id)""",
    "date_slices": _with("bi") + """
select cast(datestamp as date) as slice_start, cast(datestamp as date) + 1 as slice_end,
       count(*)::BIGINT as n_rows from bi group by 1, 2""",
}
_ORACLE["read_waits_all"] = f"""
with a as ({_ORACLE["read_waits"]}),
b as ({_ORACLE["read_waits_migrated"]}),
c as ({_ORACLE["previous_mount"]})
select a.sfbr_id, a.next_mount_id, b.migration_next_mount_id, c.previous_mount_100d_id,
       a.wait_us as next_wait_us, a.age_months as next_age_months, a.age_days as next_age_days,
       a.age_us as next_age_us,
       b.wait_us as mig_wait_us, b.age_months as mig_age_months, b.age_days as mig_age_days,
       b.age_us as mig_age_us,
       c.wait_us as prev_wait_us, c.age_months as prev_age_months, c.age_days as prev_age_days,
       c.age_us as prev_age_us
from a join b using (sfbr_id) join c using (sfbr_id)"""
_ORACLE["storage_waits_all"] = f"""
with a as ({_ORACLE["store_waits"]}),
b as ({_ORACLE["restore_chain"]})
select a.storageinfo_id,
       case when a.next_mount_id is not null then a.volume else b.volume end as volume,
       a.updated, b.volume_done, b.wait_done,
       coalesce(a.next_mount_time, b.next_mount_time) as next_mount_time, a.next_mount_id,
       coalesce(a.wait_us, b.wait_us) as wait_us, coalesce(a.age_months, b.age_months) as age_months,
       coalesce(a.age_days, b.age_days) as age_days, coalesce(a.age_us, b.age_us) as age_us
from a join b using (storageinfo_id)"""
_ORACLE["enrich_update"] = _ORACLE["restore_host_volume"].replace(
    "select st.storageinfo_id, case when", "select st.storageinfo_id, st.action, case when")


_ORACLE["package_reads_bucketed"] = _ORACLE["package_reads"]
_ORACLE["read_waits_late"] = _ORACLE["read_waits_all"]
_ORACLE["enrich_in_place"] = _ORACLE["enrich_update"]
_ORACLE["date_copy"] = _with("bi") + """
select cast(datestamp as date) as day, count(*)::BIGINT as n_rows, count(distinct billinginfo_id)::BIGINT as n_ids
from bi where datestamp >= date '1995-12-01' and datestamp < date '1997-01-01' group by 1"""
_MOVED = "make_timestamp(788918400000000 + (epoch_us(start) - 1704067200000000) * 80)"
_ORACLE["read_waits_chain"] = f"""
with {_CTE["vol"]}, {_CTE["fam"]}, {_CTE["fl"]}, {_CTE["pk"]}, {_CTE["bi"]},
{_CTE["tm"].replace("tm as (", "tm0 as (", 1)},
tm as (select tapemount_id, volume, {_MOVED} as start, {_MOVED} + (finish - start) as finish, writes from tm0),
{_CTE["fm"]}, {_first_mount_by_volume()}, {_first_mount_by_family()},
r as (select row_number() over () as rn, p.billinginfo_id as sfbr_id, p.pnfsid, p.datestamp::TIMESTAMP as datestamp,
             {_BFID_T} as bt, f.file_family, p.volume as migrated
      from (select * from bi join pk using (pnfsid)) p left join fam f on f.label = p.volume),
h as (select r.*, case when m.start < r.bt + interval 8640000 second then m.tapemount_id end as hid
      from r asof left join mf m on r.file_family = m.file_family and r.bt < m.start),
v as (select h.*, t.volume from h left join tm t on t.tapemount_id = h.hid),
a as (select v.*, case when m.start < v.datestamp + interval 100 day then m.tapemount_id end as nid,
             case when m.start < v.datestamp + interval 100 day then m.start end as nst
      from v asof left join mv m on v.volume = m.volume and v.datestamp < m.start),
b as (select a.*, case when m.start < a.datestamp + interval 100 day then m.tapemount_id end as gid,
             case when m.start < a.datestamp + interval 100 day then m.start end as gst
      from a asof left join mv m on a.migrated = m.volume and a.datestamp < m.start),
c as (select b.*, case when m.start > b.datestamp - interval 100 day then m.tapemount_id end as qid
      from b asof left join mv m on b.migrated = m.volume and b.datestamp > m.start)
select c.sfbr_id, c.pnfsid, c.volume, c.nid as next_mount_id, c.gid as migration_next_mount_id,
       case when t.finish is not null then c.qid end as previous_mount_100d_id,
       epoch_us(c.nst) - epoch_us(c.datestamp) as next_wait_us, epoch_us(c.gst) - epoch_us(c.datestamp) as mig_wait_us,
       epoch_us(t.finish) - epoch_us(c.datestamp) as prev_wait_us
from c left join tm t on t.tapemount_id = c.qid"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each registered query (same column names and values)."""
    names = set(queries())
    out = {k: v for k, v in _ORACLE.items() if k in names}
    if llm_queries is not None:
        out |= llm_queries.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out

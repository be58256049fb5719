"""Column contracts of the tables the jobs read and write.

Names, not positions: a table is accepted when it has at least these
columns, castable to these types.  Result columns of the enriched tables are
optional on input (absent means "not computed yet").
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = T.TimestampNTZType()


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FILE = _s(("id", T.LongType()), ("pnfsid", T.StringType()),
          ("package_id", T.LongType()), ("original_library", T.StringType()),
          ("bfid", T.StringType()), ("volume", T.StringType()))
BILLINGINFO = _s(("billinginfo_id", T.LongType()), ("pnfsid", T.StringType()), ("datestamp", TS))
VOLUME = _s(("id", T.LongType()), ("label", T.StringType()), ("file_family", T.StringType()))
TAPE_MOUNTS = _s(("tapemount_id", T.LongType()), ("volume", T.StringType()), ("start", TS),
                 ("finish", TS), ("writes", T.LongType()))
SMALL_FILE_READS = _s(("sfbr_id", T.LongType()), ("bfid", T.StringType()), ("datestamp", TS),
                      ("file_family", T.StringType()), ("volume", T.StringType()),
                      ("migrated_volume", T.StringType()))
STORAGEINFO = _s(("storageinfo_id", T.LongType()), ("action", T.StringType()),
                 ("errorcode", T.IntegerType()), ("updated", T.BooleanType()),
                 ("pnfsid", T.StringType()), ("bfid", T.StringType()), ("datestamp", TS),
                 ("file_family", T.StringType()), ("volume", T.StringType()))

# The request log before family, tape and done flag are added.
RAW_STORAGEINFO = _s(*[(f.name, f.dataType) for f in STORAGEINFO.fields
                       if f.name not in ("updated", "file_family", "volume")])

CONTRACTS = {
    "storageinfo": RAW_STORAGEINFO,
    "file": FILE,
    "billinginfo": BILLINGINFO,
    "volume": VOLUME,
    "tape_mounts": TAPE_MOUNTS,
    "small_file_billinginfo_reads": SMALL_FILE_READS,
    "storageinfo_sfa": STORAGEINFO,
}


class ContractError(ValueError):
    pass


def conform(df: DataFrame, contract: T.StructType, keep_extra: bool = True) -> DataFrame:
    """Check that ``df`` has the contract's columns and cast them to its types.

    Only a projection: Catalyst folds it into the scan, so pruning and
    pushdown are unaffected.
    """
    have = {f.name for f in df.schema.fields}
    missing = [f.name for f in contract.fields if f.name not in have]
    if missing:
        raise ContractError(f"missing columns {missing}; have {sorted(have)}")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields]
    if keep_extra:
        names = {f.name for f in contract.fields}
        cols += [F.col(c) for c in df.columns if c not in names]
    return df.select(*cols)

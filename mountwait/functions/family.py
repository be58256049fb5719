"""File-family key: the name under which a family's tape labels are kept.

Separators ``-`` and ``/`` are mapped to ``_``, which makes distinct families
share one key (``a-b``, ``a/b``, ``a_b``); the library therefore joins on the
exact family value and offers the key only for reports (see
``operators.aggregates.family_key_collisions``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (naming convention of the per-family label tables).
FAMILY_KEY_PREFIX = "volume_labels_ff_"
FAMILY_KEY_SEPARATORS = "[-/]"


def family_key(file_family) -> Column:
    c = F.col(file_family) if isinstance(file_family, str) else file_family
    return F.concat(F.lit(FAMILY_KEY_PREFIX), F.regexp_replace(c, FAMILY_KEY_SEPARATORS, "_"))

"""Province dimension out of a national area table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where the code sits in the national code, and the code of unassociated islets.
CODE_START, CODE_LENGTH = 5, 2
NOT_A_PROVINCE = "54"


def prepare_provinces(areas: DataFrame) -> DataFrame:
    """(province_code, name, geom) of areas(national_code, name, geom), in code order."""
    code = F.substring(F.col("national_code"), CODE_START, CODE_LENGTH)
    return (
        areas.select(code.alias("province_code"), "name", "geom")
        .where(F.col("province_code") != NOT_A_PROVINCE)
        .orderBy("province_code")
    )

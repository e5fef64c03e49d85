"""Unicode forms; Spark has no normalising function of its own."""

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

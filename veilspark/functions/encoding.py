"""Scalar encodings: dates, money, prefixes, interval codec, powers of two, row encryption."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def date_int(c: str | Column) -> Column:
    """yyyymmdd; integer order is date order."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.day(c)).cast("int")


def cents(c: str | Column) -> Column:
    """Hundredths, truncated."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("double") * 100).cast("int")


def prefix(c: str | Column, k: int) -> Column:
    """The first k characters; shorter values as they are."""
    return F.substring(c, 1, k)


def interval(lo: str | Column, hi: str | Column) -> Column:
    """Two 32-bit positions in one 64-bit number."""
    lo, hi = (F.col(x) if isinstance(x, str) else x for x in (lo, hi))
    return F.shiftleft(lo.cast("long"), 32).bitwiseOR(hi.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def interval_bounds(c: str | Column) -> tuple[Column, Column]:
    c = F.col(c) if isinstance(c, str) else c
    low = c.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(c, 32).cast("int"), F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def next_power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def previous_power_of_two(n: int) -> int:
    """The greatest one below n."""
    return 1 << ((n - 1).bit_length() - 1) if n > 1 else 1


def session_key() -> bytes:
    """A fresh 128-bit key."""
    return secrets.token_bytes(16)


def keep_key(spark: SparkSession, key: bytes, name: str = "veilspark.key") -> str:
    """Keep the key as a system property of the driver's JVM and give the property's name."""
    spark._jvm.java.lang.System.setProperty(name, key.hex())
    return name


def _with_key(df: DataFrame, key: bytes | str) -> DataFrame:
    """``df`` beside the key (column ``__key``), which goes to executors as a broadcast table of one row, so that plans,
    the UI and event logs don't show it. A name is looked up on the driver, at once."""
    spark = df.sparkSession
    if isinstance(key, str):
        found = spark._jvm.java.lang.System.getProperty(key)
        if found is None:
            raise ValueError(f"no key in the property {key}")
        key = bytes.fromhex(found)
    return df.crossJoin(F.broadcast(spark.createDataFrame([(bytearray(key),)], "__key binary")))  # one row


def _survives(kind: T.DataType) -> bool:
    """Does a value come back from JSON as it was?"""
    if isinstance(kind, T.StructType):
        return all(_survives(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _survives(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _survives(kind.valueType)
    return isinstance(kind, T.StringType | T.BooleanType | T.IntegralType | T.FractionalType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BinaryType)


_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def encrypt_rows(df: DataFrame, key: bytes | str, equal_length: bool = False) -> DataFrame:
    """Each row as one AES-GCM blob with a fresh initialisation vector (column ``blob``), to the microsecond; columns of
    types that JSON doesn't carry raise. ``equal_length`` fills all rows up to the next power of two of the longest."""
    lost = [f.name for f in df.schema if not _survives(f.dataType)]
    if lost:
        raise TypeError(f"{lost} can't be encrypted without loss")
    whole = df.select(F.encode(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"} | _TIMES), "utf-8").alias("row"))
    row = F.col("row")
    if equal_length:
        most = whole.agg(F.max(F.octet_length("row"))).first()[0] or 1
        row = F.rpad(row, next_power_of_two(most), F.lit(b" "))
    return _with_key(whole, key).select(F.aes_encrypt(row, F.col("__key"), F.lit("GCM")).alias("blob"))


def decrypt_rows(df: DataFrame, key: bytes | str, schema) -> DataFrame:
    """The rows again; a changed blob, a wrong key or a row that doesn't fit the schema raises."""
    text = F.decode(F.aes_decrypt("blob", F.col("__key"), F.lit("GCM")), "utf-8")
    return _with_key(df.select("blob"), key).select(F.from_json(text, schema, {"mode": "FAILFAST"} | _TIMES).alias("r")).select("r.*")

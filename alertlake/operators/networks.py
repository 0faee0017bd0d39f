"""Address scopes by a network table of any size.

Networks of one prefix length hold an address exactly if they equal the address cut to that length.
So the distinct addresses are cut to every length the table has (at most 33 for IPv4 and 129 for
IPv6) and joined by equality: the cost of an address does not grow with the number of networks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions import ip
from alertlake.functions.text import let
from alertlake.session import written

_MAPPED = "^::ffff:(?=.*[.])"
_LENGTHS = 256


def address_digits(address: Column) -> Column:
    """8 hexadecimal digits for IPv4, also IPv4-mapped, and 32 for IPv6; null for other text."""
    four = let(ip.v4_number(F.regexp_replace(address, _MAPPED, "")), lambda n: F.lower(F.lpad(F.hex(n), 8, "0")))
    return F.coalesce(four, ip.v6_hex(address))


def cut_to(digits: Column, bits: Column) -> Column:
    """The first bits of an address, the last digit's other bits zero."""
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.expr("array(16, 8, 4, 2)")
    last = let(digit, lambda d: F.lower(F.hex(d - d % F.get(step, rest))))
    return F.concat(F.substr(digits, F.lit(1), whole), F.when(rest > 0, last).otherwise(""))


def network_table(networks: DataFrame, network: str = "network", label: str = "label", rank: str = "rank") -> DataFrame:
    """(size, bits, prefix, place, label) of networks in CIDR form; an address alone is a network of one.

    Bits behind the prefix are ignored. Of repeated networks the smallest rank counts, then the
    first label by text. A text that is no network ends the run with a ValueError.
    """
    c = F.col
    text = F.btrim(c(f"`{network}`").cast("string"))
    host = F.lower(F.substring_index(text, "/", 1))
    length = F.regexp_extract(text, r"^[^/]*/([0-9]{1,3})\z", 1).try_cast("int")
    given = networks.select(text.alias("text"), address_digits(host).alias("digits"), host.rlike(_MAPPED).alias("mapped"),
                            length.alias("length"), c(f"`{label}`").cast("string").alias("label"), c(f"`{rank}`").cast("bigint").alias("rank"))
    size = F.length("digits") * 4
    bits = F.when(F.contains(c("text"), F.lit("/")), c("length") - F.when(c("mapped"), 96).otherwise(0)).otherwise(size)
    made = written(given.select("text", "digits", "label", "rank", size.alias("size"), bits.alias("bits")), "networks")
    wrong = made.filter(F.coalesce(~c("bits").between(0, c("size")), F.lit(True)) | c("rank").isNull()).select("text").first()
    if wrong:
        raise ValueError(f"not a network with a rank: {wrong['text']!r}")
    place = (c("rank") * _LENGTHS + (_LENGTHS - 1 - c("bits"))).alias("place")
    keyed = made.select("size", "bits", cut_to(c("digits"), c("bits")).alias("prefix"), place, "label")
    return keyed.groupBy("size", "bits", "prefix").agg(F.min(F.struct("place", "label")).alias("first")).select("size", "bits", "prefix", "first.*")


def with_network(df: DataFrame, address: str, networks: DataFrame, out: str = "scope", otherwise: str = "Public/External", unknown: str = "Unknown") -> DataFrame:
    """The rows with the label of the first network, by rank, that holds their address.

    `networks` comes from `network_table`. Of equal ranks the longer prefix wins. Addresses in no
    network get `otherwise`, texts that are no address, and nulls, get `unknown`. A column called
    like `out` gives way. Addresses are looked up once each, however many rows share one.
    """
    c = F.col
    networks = written(networks, "network-table")
    lengths: dict[int, list[int]] = {32: [], 128: []}
    for row in networks.select("size", "bits").distinct().collect():
        lengths[row["size"]].append(row["bits"])
    rows = df.drop(out) if out != address else df
    known = rows.select(c(f"`{address}`").cast("string").alias("a")).filter("a is not null").distinct()
    digits = written(known.select("a", address_digits(c("a")).alias("h")).filter("h is not null"), "addresses")
    size = F.length("h") * 4

    def wanted(bits: list[int]) -> Column:
        return F.array(*map(F.lit, sorted(bits))).cast("array<int>")

    cuts = F.when(size == 32, wanted(lengths[32])).otherwise(wanted(lengths[128]))
    cut = digits.select("h", size.alias("size"), F.explode(cuts).alias("bits")).distinct()
    keyed = cut.withColumn("prefix", cut_to(c("h"), c("bits")))
    first = keyed.join(networks.drop("label"), ["size", "bits", "prefix"]).groupBy("h").agg(F.min("place").alias("place"))
    # The place names the prefix length, and so the one network of this length that holds the address.
    bits = (F.lit(_LENGTHS - 1) - F.pmod(c("place"), F.lit(_LENGTHS))).cast("int")
    found = first.select("h", size.alias("size"), bits.alias("bits")).withColumn("prefix", cut_to(c("h"), c("bits")))
    labels = found.join(networks.drop("place"), ["size", "bits", "prefix"]).select("h", c("label"))
    scopes = digits.join(labels, "h", "left").select(c("a").alias("__a"), F.coalesce("label", F.lit(otherwise)).alias("__scope"))
    joined = rows.join(scopes, rows[f"`{address}`"].cast("string") == scopes["__a"], "left")
    return joined.withColumn(out, F.coalesce("__scope", F.lit(unknown))).drop("__a", "__scope")

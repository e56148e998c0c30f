"""Records from JSON or delimited bodies: paths, renames, scales, transforms, reductions, merged requests.

``fetch`` reads over HTTPS under a policy (no private hosts, no redirects, limits on size, time and
number); requests of one address are made once.  Everything after the bodies are DataFrames.
"""

from __future__ import annotations

import ipaddress
import os
import re
import socket
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import PlanError

MOST_BYTES, MOST_REQUESTS, SECONDS = 20_000_000, 64, 30


def secret(text: str, given: dict[str, str] | None = None) -> str:
    """Fills {{secret:name}} from what is given, else from the environment."""
    def one(m: re.Match) -> str:
        v = (given or {}).get(m[1], os.environ.get(m[1].upper()))
        if v is None:
            raise PlanError("BAD_SOURCE", f"secret {m[1]!r} is not set")
        return v

    return re.sub(r"\{\{secret:(\w+)\}\}", one, text)


def check_url(url: str, resolve: Callable[[str], list[str]] | None = None) -> None:
    """HTTPS to a public host, or an error."""
    u = urllib.parse.urlsplit(url)
    if u.scheme != "https" or not u.hostname:
        raise PlanError("BAD_SOURCE", "sources are https addresses")
    names = resolve or (lambda h: [a[4][0] for a in socket.getaddrinfo(h, 443)])
    try:
        found = [str(ipaddress.ip_address(u.hostname))]
    except ValueError:
        found = names(u.hostname)
    for a in found:
        if not ipaddress.ip_address(a).is_global:
            raise PlanError("BAD_SOURCE", f"{u.hostname} is no public host")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        raise PlanError("BAD_SOURCE", "the source redirects")


def fetch(url: str) -> str:
    check_url(url)
    with urllib.request.build_opener(_NoRedirect).open(url, timeout=SECONDS) as r:
        data = r.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise PlanError("BAD_SOURCE", "the body is too long")
    return data.decode()


def json_records(bodies: DataFrame, path: str = "", keyed: bool = True) -> DataFrame:
    """From a column ``body``: the array at a dotted path, an object of records (id: its key), or one record.

    Fields come out as text (nested ones as JSON text), in map column ``rec``, with ``n`` their place.
    """
    at = "$" + "".join(f"['{p}']" for p in path.split(".") if p)
    node = F.get_json_object("body", at) if path else F.col("body")
    as_array = F.from_json(node, "array<map<string,string>>")
    of_records = F.from_json(node, "map<string,map<string,string>>")
    single = F.from_json(node, "map<string,string>")
    is_array = F.ltrim(node).startswith("[")
    nested = F.size(F.filter(F.map_values(single), lambda v: F.ltrim(v).startswith("{"))) == F.size(single)
    from_map = F.transform(F.map_entries(of_records), lambda e: F.map_concat(F.map_filter(e["value"], lambda k, v: k != "id"), F.create_map(F.lit("id"), F.coalesce(F.try_element_at(e["value"], F.lit("id")), e["key"]))))
    rows = F.when(is_array, as_array).when(F.lit(keyed) & nested & (F.size(single) > 0), from_map).otherwise(F.array(single))
    return bodies.select(*[c for c in bodies.columns if c != "body"], F.posexplode(rows).alias("n", "rec"))


def pick(path: str, rec: Column | None = None) -> Column:
    """A field of ``rec`` by dotted path."""
    rec = F.col("rec") if rec is None else rec
    first, _, rest = path.partition(".")
    v = F.try_element_at(rec, F.lit(first))
    return F.get_json_object(v, "$." + rest) if rest else v


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "number": lambda c: c.try_cast("double"),
    "text": lambda c: c,
    "year": lambda c: F.substring(c, 1, 4).try_cast("double"),
    "date": lambda c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"),
    "abs": lambda c: F.abs(c.try_cast("double")),
    "neg": lambda c: -c.try_cast("double"),
}


def map_records(records: DataFrame, fields: dict[str, object], scale: float = 1.0, unscaled: tuple = (), id: str | None = None, constants: dict | None = None) -> DataFrame:
    """Renamed, typed columns.  fields: name -> path or (path, transform); ``id`` is a template like '{t}_{fiscal_year}'."""
    cols = []
    for name, spec in fields.items():
        path, how = (spec, "text") if isinstance(spec, str) else spec
        v = TRANSFORMS[how](pick(path))
        if how in ("number", "abs", "neg") and scale != 1.0 and name not in unscaled:
            v = v / F.lit(scale)
        cols.append(v.alias(name))
    out = records.select(*[c for c in records.columns if c != "rec"], *cols, *(F.lit(v).alias(k) for k, v in (constants or {}).items()))
    if id:
        parts, at = [], 0
        for m in re.finditer(r"\{(\w+)\}", id):
            c = F.col(m[1])
            shown = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string")) if dict(out.dtypes)[m[1]] == "double" else c.cast("string")
            parts += [F.lit(id[at : m.start()]), F.coalesce(shown, F.lit(""))]
            at = m.end()
        out = out.withColumn("id", F.concat(*parts, F.lit(id[at:])))
    return out


def reduce_records(df: DataFrame, by: list[str], order: str, take: int, skip: int = 0, sums: list[str] = (), after: object = None, descending: bool = True) -> DataFrame:
    """One record a key: the first of ``take`` in order after ``skip``, with ``sums`` added up over them."""
    if after is not None:
        df = df.filter(F.col(order) > F.lit(after))
    w = Window.partitionBy(*by).orderBy(F.desc(order) if descending else F.asc(order))
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") > skip) & (F.col("_rn") <= skip + take))
    rest = [c for c in df.columns if c not in by]
    aggs = [(F.sum(c) if c in sums else F.min_by(c, "_rn")).alias(c) for c in rest]
    return ranked.groupBy(*by).agg(*aggs).select(*df.columns)


def merge_requests(parts: list[DataFrame]) -> DataFrame:
    """Records of several requests by id; of two values the later request's counts."""
    whole = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        whole = p if whole is None else whole.unionByName(p, allowMissingColumns=True)
    names = [c for c in whole.columns if c not in ("id", "_part")]
    return whole.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_part"))).alias(c) for c in names))


def read_source(spark: SparkSession, source: dict, secrets: dict | None = None, get: Callable[[str], str] = fetch) -> DataFrame:
    """{requests: [{url, path, fields, scale, id, ...}]}: fetched, mapped and merged."""
    requests = source.get("requests") or [source]
    if len(requests) > MOST_REQUESTS:
        raise PlanError("BAD_SOURCE", f"over {MOST_REQUESTS} requests")
    seen: dict[str, str] = {}
    parts = []
    for r in requests:
        url = secret(r["url"], secrets)
        if url not in seen:
            seen[url] = get(url)
        bodies = spark.createDataFrame([(seen[url],)], "body string")
        rows = map_records(json_records(bodies, r.get("path", "")), {k: tuple(v) if isinstance(v, list) else v for k, v in r["fields"].items()}, r.get("scale", 1.0), tuple(r.get("unscaled", ())), r.get("id"), r.get("constants"))
        if "reduce" in r:
            rows = reduce_records(rows, **r["reduce"])
        parts.append(rows.drop("n"))
    return merge_requests(parts)

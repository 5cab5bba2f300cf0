"""Projections and scalar functions over spans, paths and values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def assign_opaque_ids(df: DataFrame, keys: list[str], salt: str, name: str = "opaque_id") -> DataFrame:
    """``df`` with an id that a salted sha256 of the keys gives; ``binding_table`` keeps what it stands for."""
    return df.withColumn(name, F.sha2(F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256))


def binding_table(df: DataFrame, keys: list[str], salt: str, name: str = "opaque_id") -> DataFrame:
    """The private table of opaque ids and the keys behind them, in order of the opaque id, so that no batch shows."""
    return assign_opaque_ids(df.select(*keys).distinct(), keys, salt, name).select(name, *keys).orderBy(name)


def _tag(*names: str) -> Column:
    return F.coalesce(*[F.col("tags").getItem(n) for n in names])


def _observed(spans: DataFrame, services: list[str]) -> DataFrame:
    """Client and server spans of the services with a method and no other scheme than http(s), with ``rules``: what refuses them."""
    url = _tag("http.url", "url.full", "http.target")
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rows = spans.where(F.col("service").isin(services) & F.col("kind").isin("CLIENT", "SERVER") & _tag("http.method", "http.request.method").isNotNull() & scheme.isin("", "http", "https"))
    timing = F.expr("start_us is null or start_us < 0 or duration_us is null or duration_us < 0")
    path = url_path(url)
    return rows.withColumn("rules", F.array_compact(F.array(F.when(timing, F.lit("bad_timing")), F.when(path.isNull() | ~path.startswith("/"), F.lit("bad_path")))))


def observation_violations(spans: DataFrame, services: list[str]) -> DataFrame:
    """(trace, span, rule) of client and server spans of the services that can't be projected: bad_timing or bad_path."""
    return _observed(spans, services).select("trace", "span", F.explode("rules").alias("rule"))


def parse_traceparent(header: Column) -> Column:
    """(trace_id, span_id, sampled) of a version-00 header; null where the form is wrong or an id is zero."""
    form = r"^00-(?!0{32})([0-9a-f]{32})-(?!0{16})([0-9a-f]{16})-0([01])$"
    return F.when(header.rlike(form), F.struct(F.regexp_extract(header, form, 1).alias("trace_id"), F.regexp_extract(header, form, 2).alias("span_id"), (F.regexp_extract(header, form, 3) == "1").alias("sampled")))


def url_path(url: Column) -> Column:
    """The path of a URL or target, without query and fragment."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def project_observations(spans: DataFrame, services: list[str]) -> DataFrame:
    """Client and server spans of the services with a method: event_id parts, service, kind, method, path, peer, start_us, duration_us, status_code.

    Spans that ``observation_violations`` names are refused.
    """
    url = _tag("http.url", "url.full", "http.target")
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1)
    rows = _observed(spans, services).where(F.size("rules") == 0)
    return rows.select("trace", "span", "parent", "service", "kind", F.upper(_tag("http.method", "http.request.method")).alias("method"), url_path(url).alias("path"), F.when(F.col("kind") == "CLIENT", host).alias("peer"), "start_us", "duration_us", _tag("http.status_code", "http.response.status_code").cast("int").alias("status_code"))


def contained(texts: DataFrame, idents: DataFrame, text: str, ident: str) -> DataFrame:
    """The rows of ``texts`` with every id that occurs anywhere in the text, once for each.

    Texts are cut into all strings of each length that ids have, which meet the ids by an equal join.
    """
    known = idents.select(F.col(ident).cast("string").alias(ident)).where(F.length(ident) > 0).distinct()
    lengths = [r[0] for r in known.select(F.length(ident)).distinct().collect()]  # ids have a few lengths
    if not lengths:
        return texts.withColumn(ident, F.lit("")).limit(0)

    def cuts_of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substring(F.col(text), k, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    cuts = F.concat(*map(cuts_of, lengths))
    return texts.withColumn(ident, F.explode(F.array_distinct(cuts))).join(known, ident, "left_semi")


def leak_check(public: DataFrame, private: DataFrame, text: str, ident: str, substring: bool = False) -> DataFrame:
    """Private ids that stand as a token in a public text or, with ``substring``, anywhere in one."""
    if substring:
        found = contained(public.select(text), private, text, ident).select(ident)
        return private.select(ident).distinct().join(found.distinct(), ident, "left_semi")
    tokens = public.select(F.explode(F.split(F.col(text), r"[^A-Za-z0-9_-]+")).alias(ident)).distinct()
    return private.select(ident).distinct().join(tokens, ident, "left_semi")


def classify_exposure(value: Column, original: Column) -> Column:
    """How much of the original a shown value gives away."""
    masked = value.rlike(r"^[*Xx#]*$") | (F.right(value, F.lit(4)) == F.right(original, F.lit(4))) & F.left(value, F.length(value) - 4).rlike(r"^[*Xx# -]*$")
    return F.when(value.isNull() | (value == ""), "absent_or_empty").when(value == original, "full_value_returned").when(masked, "last_four_only_or_masked").otherwise("different_value_needs_review")


def wildcard_path_match(path: Column, pattern: Column, strict: bool = True) -> Column:
    """Same number of segments, each equal or matched by ``*``: a decimal segment if strict, else any."""
    a, b = F.split(path, "/"), F.split(pattern, "/")
    one = lambda x, y: (x == y) | ((y == "*") & (x.rlike(r"^[0-9]+$") if strict else F.lit(True)))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, one), lambda x: x)


def generalise_path(path: Column) -> Column:
    """Decimal segments as ``*``."""
    return F.regexp_replace(path, r"/[0-9]+(?=/|$)", "/*")


def categorize(df: DataFrame, kinds: dict[str, str], kind: str = "kind") -> DataFrame:
    """``category`` of each kind; kinds that the map lacks have null."""
    return df.withColumn("category", F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col(kind)])


def unmapped_kinds(df: DataFrame, kinds: dict[str, str], kind: str = "kind") -> DataFrame:
    """Kinds that the map lacks, with how many rows have them."""
    return df.where(F.col(kind).isNull() | ~F.col(kind).isin(*kinds)).groupBy(kind).agg(F.count("*").alias("n"))


def split_phase(requests: DataFrame, case: str, prefix: str = "warm-up") -> DataFrame:
    """``phase`` warm-up or steady by the case's prefix."""
    return requests.withColumn("phase", F.when(F.col(case).startswith(prefix), "warm-up").otherwise("steady"))


def phase_violations(requests: DataFrame, group: list[str], case: str, start: str, end: str, prefixes: tuple[str, str] = ("warm-up", "steady")) -> DataFrame:
    """Groups whose phases aren't apart: a case of neither phase, or a warm-up that ends after the steady phase starts."""
    warm, steady = (F.col(case).startswith(p) for p in prefixes)
    s = requests.groupBy(*group).agg(F.count_if(~(warm | steady) | F.col(case).isNull()).alias("neither"), F.max(F.when(warm, F.col(end))).alias("warm_end"), F.min(F.when(steady, F.col(start))).alias("steady_start"))
    rules = F.array_compact(F.array(F.when(F.col("neither") > 0, F.lit("no_phase")), F.when(F.col("warm_end") > F.col("steady_start"), F.lit("phases_overlap"))))
    return s.select(*group, F.explode(rules).alias("rule"))


def stratified_sample(candidates: DataFrame, app: str, stratum: str, ident: str, n: int, salt: str) -> DataFrame:
    """n rows an app: ranked by a salted hash inside each stratum, then taken round-robin over the strata in name order."""
    order = F.sha2(F.concat(F.lit(salt), F.col(ident).cast("string")), 256)
    rows = candidates.withColumn("__rank", F.row_number().over(Window.partitionBy(app, stratum).orderBy(order, ident)))
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(app).orderBy("__rank", stratum))).where(F.col("pick") <= n).drop("__rank")


def _leaves(value, path: str, style: str, out: list) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _leaves(v, f"{path}[{json.dumps(k, ensure_ascii=False)}]" if style == "jsonpath" else f"{path}/{k.replace('~', '~0').replace('/', '~1')}", style, out)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            _leaves(v, f"{path}[{k}]" if style == "jsonpath" else f"{path}/{k}", style, out)
    elif style == "pointer":
        out.append((path, value if isinstance(value, str) else json.dumps(value)))
    elif isinstance(value, str):
        out.append((path, value))


def json_leaves(df: DataFrame, json_col: str, keys: list[str], style: str = "jsonpath", min_len: int = 3) -> DataFrame:
    """keys, path, value of the string leaves of some length (``jsonpath``) or of all scalar leaves (``pointer``); text that isn't JSON has none."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
    def leaves(texts: pd.Series) -> pd.Series:
        def one(text):
            out: list = []
            try:
                _leaves(json.loads(text), "$" if style == "jsonpath" else "", style, out)
            except (TypeError, ValueError):
                return []
            return [{"path": p, "value": v} for p, v in out if style == "pointer" or len(v) >= min_len]

        return texts.map(one)

    return df.select(*keys, F.explode(leaves(F.col(json_col))).alias("leaf")).select(*keys, "leaf.path", "leaf.value")

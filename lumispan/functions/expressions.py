"""Column expressions: identities, group keys, codecs, portable random numbers, name parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = "!@#"
#: Columns of a span that can be part of its identity.
PRIMARY_KEYS = ("kind", "operation", "service", "status")
# Span kinds and statuses by their numbers in the wire format.
KINDS = ("", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUSES = ("UNSET", "OK", "ERROR")
# Suffixes of fault-injection scenarios.
FAULTS = ("cpu", "delay", "disk", "loss", "mem", "socket")


def signature(columns: dict[str, Column]) -> Column:
    """Identity of a span: key=value in order of the keys, joined by NUL; a missing value is empty."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(columns[k].cast("string"), F.lit(""))) for k in sorted(columns)]
    return F.concat_ws("\0", *parts)


def signature_value(sig: Column, key: str) -> Column:
    """The value of one key of a signature, '' where it is missing."""
    found = F.filter(F.split(sig, "\0"), lambda x: x.startswith(f"{key}="))
    return F.coalesce(F.substring(F.get(found, 0), len(key) + 2, 1 << 20), F.lit(""))


def group_entries(columns: dict[str, Column]) -> Column:
    """Sorted column:value entries of the columns that aren't empty."""
    entries = [
        F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}:"), c.cast("string")))
        for k, c in columns.items()
    ]
    return F.array_sort(F.filter(F.array(*entries), lambda x: x.isNotNull()))


def span_entries(columns: dict[str, Column], attributes: Column, names: tuple[str, ...] | None = ()) -> Column:
    """Sorted column:value entries of columns and attributes that aren't empty. An attribute hides the column of its name,
    even where it is empty itself. ``names`` are the attributes to look at; None is all of them."""
    none = F.create_map().cast("map<string,string>")
    held = F.coalesce(attributes, none)
    if names is not None:
        held = F.map_filter(held, lambda k, v: k.isin(*names)) if names else none
    own = [
        F.when(~F.map_contains_key(held, k) & (F.coalesce(c.cast("string"), F.lit("")) != ""), F.concat(F.lit(f"{k}:"), c.cast("string")))
        for k, c in columns.items()
    ]
    extra = F.transform(F.filter(F.map_entries(held), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.array_sort(F.filter(F.concat(F.array(*own), extra), lambda x: x.isNotNull()))


def group_keys(entries: Column) -> Column:
    """'all', every entry, and every pair of entries: the filters that trace queries are answered for."""
    pairs = F.flatten(
        F.transform(
            entries,
            lambda a, i: F.transform(
                F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))),
                lambda b: F.concat(a, F.lit(PAIR), b),
            ),
        )
    )
    return F.concat(F.array(F.lit("all")), entries, pairs)


def filter_level(key: Column) -> Column:
    """How many attributes a group key names."""
    return F.when(key == "all", 0).when(key.rlike("^(time|operation)_"), 0).otherwise(F.size(F.split(key, PAIR)))


def filter_columns(key: Column) -> Column:
    """The column names of a group key, each cut at its first colon."""
    return F.transform(F.split(key, PAIR), lambda p: F.substring_index(p, ":", 1))


def kind_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(k) for k in KINDS]), F.greatest(code.cast("int"), F.lit(0))), F.lit(""))


def status_text(code: Column) -> Column:
    """'0', '1' or '2'; anything else counts as '0'."""
    return F.when(code.cast("int").isin(0, 1, 2), code.cast("int").cast("string")).otherwise("0")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def padded_hex(value: Column, width: int) -> Column:
    return F.lpad(F.lower(value), width, "0")


def hash32(*parts) -> Column:
    """32 bits from the md5 of the parts joined by ':': the random number that any engine can repeat."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """In (0, 1)."""
    return (hash32(*parts).cast("double") + 0.5) / float(1 << 32)


def normal(*parts) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2.0 * F.log(uniform("n1", *parts))) * F.cos(2.0 * 3.141592653589793 * uniform("n2", *parts))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(x, hi))


def symmetric_error(base: Column, other: Column) -> Column:
    """In percent: 0 where both are 0, 100 where only the base is 0 or less."""
    return (
        F.when(base > 0, F.abs(base - other) / (base + other) * 100.0)
        .when((base == 0) & (other == 0), 0.0)
        .otherwise(100.0)
    )


def fidelity(mean_error: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - mean_error)


def sampling_rate(approach: Column) -> Column:
    """N of head_N or sifter_N; 1 for everything else."""
    n = F.regexp_extract(approach, r"(?:^|_)(?:head|sifter)_(\d+)", 1)
    return F.when(n == "", 1).otherwise(n.cast("int"))


def query_section(query: Column) -> Column:
    """What stands before the first '::' of a report's query; all of it where there is none."""
    return F.substring_index(query, "::", 1)


def query_key(query: Column) -> Column:
    """The group key of a report's query: what follows the first '::'."""
    at = F.instr(query, "::")
    return F.when(at > 0, F.substring(query, at + 2, F.length(query))).otherwise("")


def section_kind(section: Column) -> Column:
    """rate, duration or error of a section over time; other sections are their own kind."""
    over_time = F.regexp_extract(section, r"^(rate|duration|error)_over_time$|^(duration)_over_time_p", 0)
    return F.when(over_time == "", section).otherwise(F.substring_index(over_time, "_", 1))


def section_percentile(section: Column) -> Column:
    """p50 and the like of a section of durations, else '-'."""
    found = F.regexp_extract(section, r"^duration_over_time_(p.*)$", 1)
    return F.when(found == "", "-").otherwise(found)


#: Words that an approach's name begins with, after that of an application.
APPROACHES = ("head", "hindsight", "model", "sifter", "tail")


def experiment(name: Column, approaches: tuple[str, ...] = APPROACHES) -> Column:
    """An experiment's name, <application>_<approach>_<iteration>, as a struct of approach, variant (its rate, or what sets
    it apart from others of its approach), display and iteration ('1' where none is given); null without a known approach."""
    parts = F.split(name, "_")
    at = _first_of(parts, approaches)
    last = F.element_at(parts, -1)
    numbered = last.rlike("^[0-9]+$")
    own = F.slice(parts, at, F.size(parts) - at + F.when(numbered, 0).otherwise(1))
    approach = F.get(own, 0)
    rest = F.array_join(F.slice(own, 2, F.size(own)), "_")
    rate = F.get(own, 1)
    display = (
        F.when((approach == "head") & rate.isNotNull(), F.concat(F.lit("1:"), rate))
        .when((approach == "sifter") & rate.isNotNull(), F.concat(F.lit("Sifter 1:"), rate))
        .when(approach.isin("tail", "hindsight"), F.initcap(approach))
        .otherwise(F.concat(F.initcap(approach), F.when(rest == "", "").otherwise(F.concat(F.lit(" "), rest))))
    )
    iteration = F.when(numbered, last).otherwise("1")
    out = F.struct(approach.alias("approach"), F.when(rest == "", approach).otherwise(rest).alias("variant"), display.alias("display"), iteration.alias("iteration"))
    return F.when((at > 0) & (F.size(own) > 0), out)


def _first_of(parts: Column, words: tuple[str, ...]) -> Column:
    """The place, from 1, of the first of the words; 0 where none occurs."""
    places = F.filter(F.array(*[F.array_position(parts, w) for w in words]), lambda p: p > 0)
    return F.coalesce(F.array_min(places), F.lit(0)).cast("int")


#: Head rates that overviews show.
SHOWN_RATES = (1, 2, 3, 5, 10, 20, 50, 100)


def experiment_class(of: Column, rates: tuple[int, ...] = SHOWN_RATES) -> Column:
    """The approach that an overview shows an ``experiment`` under; null for variants and rates that it leaves out."""
    rate = F.regexp_extract(of["variant"], "^([0-9]+)(_|$)", 1)
    head = F.when(rate.isin(*[str(r) for r in rates]), "Head")
    return (
        F.when(of["approach"] == "head", head)
        .when((of["approach"] == "model") & of["variant"].isin("model", "default"), "Model")
        .when((of["approach"] == "model") & (of["variant"] == "template"), "Model by template")
        .when(of["approach"].isin("tail", "hindsight"), F.initcap(of["approach"]))
        .when(of["approach"] == "sifter", "Sifter")
    )


def root_cause_of(scenario: Column) -> Column:
    """The service that a fault-injection scenario names: its name without the fault."""
    return F.regexp_replace(scenario, f"_({'|'.join(FAULTS)})$", "")


def cost_dollars(size_bytes: Column, cpu_s: Column, gpu_s: Column) -> Column:
    """Storage at 0.10 a GiB, CPU at 0.16 and GPU at 0.38 an hour."""
    return size_bytes / float(1 << 30) * 0.10 + cpu_s / 3600.0 * 0.16 + gpu_s / 3600.0 * 0.38

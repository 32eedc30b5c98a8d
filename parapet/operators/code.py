"""Layer 3: scans of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.strings import blank_strings, entropy, is_base64, strip_comments
from parapet.operators.manifest import CHILD_PROCESS, EVAL
from parapet.schema import fired, signal

#: Detector patterns; white space is spelled out, as \s differs between engines.
NET_IMPORT = r"""require[\t\n\f\r ]*\([\t\n\f\r ]*['"](?:http|https|net|dgram|tls)['"][\t\n\f\r ]*\)|from[\t\n\f\r ]+['"](?:http|https|net|dgram|tls)['"]"""
NEW_FUNCTION = r"new[\t\n\f\r ]+Function[\t\n\f\r ]*\("
VM_RUN = r"vm[\t\n\f\r ]*\.[\t\n\f\r ]*runIn(?:This|New)Context[\t\n\f\r ]*\("
PROCESS_ENV = r"process[\t\n\f\r ]*\.[\t\n\f\r ]*env(?![A-Za-z0-9_])"
VM_THIS = r"vm\.runInThisContext[\t\n\f\r ]*\("
VM_NEW = r"vm\.runInNewContext[\t\n\f\r ]*\("
SINK_REQUIRE = r"""require[\t\n\f\r ]*\([\t\n\f\r ]*[^'"`\t\n\f\r ][^)]*\)"""
#: Sinks in the order in which a package's first is told.
SINKS = (("sink_eval", EVAL), ("sink_new_function", NEW_FUNCTION), ("sink_vm_run_this_context", VM_THIS), ("sink_vm_run_new_context", VM_NEW), ("sink_dynamic_require", SINK_REQUIRE))
#: Files that bundlers write.
BUNDLED = r"^(package/)?(dist|build|out|lib)/|\.(min|bundle|prod|umd|cjs|esm|iife)\.js$"
CAPABILITIES = ("net_access", "exec", "dynamic_eval", "env_read")


def is_source(path: Column) -> Column:
    """C1."""
    return path.rlike(r"\.(js|mjs|cjs|ts)$")


def is_bundled(path: Column) -> Column:
    """C9."""
    return F.lower(path).rlike(BUNDLED)


def sources(files: DataFrame) -> DataFrame:
    """Source files (pkg_id, path, src) with comments stripped, and string contents blanked: once for all scans."""
    kept = files.filter(is_source(F.col("path"))).select(F.col("pkg_id").cast("string").alias("pkg_id"), "path", "src")
    return kept.withColumn("code", strip_comments(F.col("src"))).withColumn("calls", blank_strings(F.col("code")))


def capabilities(scanned: DataFrame) -> DataFrame:
    """pkg_id, and of each capability whether any file has it."""
    code, calls = F.col("code"), F.col("calls")
    return scanned.groupBy("pkg_id").agg(
        F.bool_or(code.rlike(NET_IMPORT)).alias("net_access"),
        F.bool_or(code.rlike(CHILD_PROCESS)).alias("exec"),
        F.bool_or(calls.rlike(EVAL) | calls.rlike(NEW_FUNCTION) | calls.rlike(VM_RUN)).alias("dynamic_eval"),
        F.bool_or(calls.rlike(PROCESS_ENV)).alias("env_read"),
    )


def capability_list(found: DataFrame) -> DataFrame:
    """pkg_id, caps: capabilities() as sorted arrays."""
    held = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in CAPABILITIES]), lambda x: x.isNotNull())
    return found.select("pkg_id", F.array_sort(held).alias("caps"))


def capability_signals(found: DataFrame, config) -> DataFrame:
    """One signal for each capability but the network, which only version diffs look at."""
    three = config.layer3
    return fired(
        found,
        (F.col("exec"), signal("capability_exec", three.capability_exec_score, "CWE-78")),
        (F.col("dynamic_eval"), signal("capability_dynamic_eval", three.capability_dynamic_eval_score, "CWE-94")),
        (F.col("env_read"), signal("capability_env_read", three.capability_env_read_score)),
    )


def literals(src: Column, least: int) -> Column:
    """Contents of quoted strings of `least` characters or more, without quotes and backslashes."""
    return F.filter(
        F.transform(F.regexp_extract_all(src, F.lit(rf"""'([^'\\]{{{least},}})'|"([^"\\]{{{least},}})\""""), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2)),
        lambda s: F.length(s) >= least,
    )


def entropy_counts(files: DataFrame, config) -> DataFrame:
    """Of each package the strings and runs looked at (total), and those that look packed (high).

    A literal counts once, and once more, as high, if it is Base64; so does each long run of hex digits.
    """
    three = config.layer3
    least, hexes = (three.entropy_min_string_len or 20) if three.entropy_min_string_len > 0 else 20, three.entropy_hex_min_len if three.entropy_hex_min_len > 0 else 64
    kept = files.filter(is_source(F.col("path")) & ~is_bundled(F.col("path"))).select(F.col("pkg_id").cast("string").alias("pkg_id"), "src")
    measured = F.transform(literals(F.col("src"), least), lambda s: F.struct((entropy(s) >= three.entropy_threshold).cast("long").alias("high"), is_base64(s, least).cast("long").alias("packed")))
    runs = F.regexp_count("src", F.lit(rf"[0-9a-fA-F]{{{hexes},}}")).cast("long")
    zero = F.lit(0).cast("long")
    each = kept.withColumn("m", measured).withColumn("runs", runs)
    packed = F.aggregate("m", zero, lambda a, x: a + x["packed"])
    return each.groupBy("pkg_id").agg(
        F.sum(F.size("m") + packed + F.col("runs")).alias("total"),
        F.sum(F.aggregate("m", zero, lambda a, x: a + x["high"]) + packed + F.col("runs")).alias("high"),
    )


def obfuscation_signals(counts: DataFrame, config) -> DataFrame:
    """C14: the share of high counts against the ratio; the score grows with it."""
    three = config.layer3
    ratio = F.col("high") / F.col("total")
    return fired(
        counts.filter("total > 0"),
        (ratio >= three.entropy_ratio_threshold, signal("obfuscation_high_entropy", F.least(ratio, F.lit(1.0)) * three.entropy_ratio_weight, detail=F.format_string("ratio=%.2f", ratio))),
    )


def sinks(scanned: DataFrame) -> DataFrame:
    """Of each package a flag for each sink, and the first (path, then order of SINKS) as first."""
    calls = F.col("calls")
    marks = scanned.select("pkg_id", "path", *[calls.rlike(p).alias(n) for n, p in SINKS])
    first = F.coalesce(*[F.when(F.col(n), F.struct(F.col("path"), F.lit(i).alias("nth"), F.lit(n).alias("sink"))) for i, (n, _) in enumerate(SINKS)])
    return marks.groupBy("pkg_id").agg(*[F.bool_or(n).alias(n) for n, _ in SINKS], F.min(first)["sink"].alias("first"))


def has_sinks(found: DataFrame) -> DataFrame:
    """Packages with any sink."""
    return found.filter("first IS NOT NULL").select("pkg_id")


def sink_signals(found: DataFrame, obfuscated: DataFrame, config) -> DataFrame:
    """One signal a sink; a single one, naming the first, in packages (pkg_id) that are obfuscated."""
    three = config.layer3
    marked = found.join(obfuscated.select("pkg_id").distinct().withColumn("packed", F.lit(True)), "pkg_id", "left").withColumn("packed", F.coalesce("packed", F.lit(False)))
    return fired(
        marked,
        (F.col("packed") & F.col("first").isNotNull(), signal("sink_with_obfuscation", three.sink_obfuscation_score, "CWE-94", detail=F.col("first"))),
        *[(~F.col("packed") & F.col(n), signal(n, three.sink_alone_score, "CWE-94")) for n, _ in SINKS],
    )


def code_signals(files: DataFrame, config) -> DataFrame:
    scanned = sources(files)
    packed = obfuscation_signals(entropy_counts(files, config), config)
    return capability_signals(capabilities(scanned), config).unionByName(packed).unionByName(sink_signals(sinks(scanned), packed, config))

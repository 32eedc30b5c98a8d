"""Layer 2: rules on a manifest's lifecycle scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.schema import signal

#: Lifecycle hooks, in order.
HOOKS = ("preinstall", "install", "postinstall", "preuninstall", "prepare")

#: Detector patterns; white space is spelled out, as \s differs between engines.
CURL_PIPE = r"curl[\t\n\f\r ]+[^\t\n\f\r ]+[\t\n\f\r ]*\|[\t\n\f\r ]*(ba)?sh"
WGET_PIPE = r"wget[\t\n\f\r ]+[^\t\n\f\r ]+[\t\n\f\r ]*\|[\t\n\f\r ]*(ba)?sh"
BASE64_DECODE = r"base64[\t\n\f\r ]+-d"
CHILD_PROCESS = r"""require[\t\n\f\r ]*\([\t\n\f\r ]*['"]child_process['"][\t\n\f\r ]*\)|from[\t\n\f\r ]+['"]child_process['"]"""
EVAL = r"(?:^|[^.\w$])eval[\t\n\f\r ]*\("
NODE_EVAL = r"node[\t\n\f\r ]+-e[\t\n\f\r ]+"
DYNAMIC_REQUIRE = r"""require[\t\n\f\r ]*\([\t\n\f\r ]*[^'"`]"""
EXTERNAL_URL = r"""https?://[^\t\n\f\r '"]+"""


def scripts_of(manifests: DataFrame) -> DataFrame:
    """pkg_id, hook, script of the non-blank hooks of manifests (pkg_id, scripts map)."""
    each = manifests.select(F.col("pkg_id").cast("string").alias("pkg_id"), F.explode(F.map_filter("scripts", lambda k, v: k.isin(*HOOKS) & (F.regexp_replace(v, r"^\s+|\s+$", "") != ""))).alias("hook", "script"))
    return each


def script_signals(manifests: DataFrame, config) -> DataFrame:
    """I1 to I9. A download piped to a shell vetoes and is the hook's only signal; I9 stands alone."""
    two = config.layer2
    script, hook = F.col("script"), F.col("hook")
    name = lambda rule: F.concat(F.lit(f"install_script_{rule}_"), hook)
    piped = F.when(script.rlike(CURL_PIPE), signal(name("curl_pipe"), cwe="CWE-506", veto=True)).when(script.rlike(WGET_PIPE), signal(name("wget_pipe"), cwe="CWE-506", veto=True))
    scored = F.filter(
        F.array(
            *[
                F.when(script.rlike(pattern), signal(name(rule), score, "CWE-506"))
                for rule, pattern, score in (
                    ("base64_decode", BASE64_DECODE, two.install_script_base64_score),
                    ("child_process", CHILD_PROCESS, two.install_script_child_process_score),
                    ("eval", EVAL, two.install_script_eval_score),
                    ("node_eval", NODE_EVAL, two.install_script_node_eval_score),
                    ("dynamic_require", DYNAMIC_REQUIRE, two.install_script_dynamic_require_score),
                    ("external_url", EXTERNAL_URL, two.install_script_external_url_score),
                )
            ]
        ),
        lambda x: x.isNotNull(),
    )
    each = scripts_of(manifests).withColumn("found", F.when(piped.isNotNull(), F.array(piped)).otherwise(scored))
    # at most five hooks a package
    every = each.groupBy("pkg_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    present = F.array(signal("install_script_present", two.install_script_present_score, "CWE-506"))
    return every.select("pkg_id", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(present)).alias("s")).select("pkg_id", "s.*")


def without_vetoed(df: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows of df (pkg_id) of packages that no signal vetoes; only these are scanned further."""
    return df.join(signals.filter("veto").select("pkg_id"), "pkg_id", "left_anti")

"""What is known of rules: tunable keys, weight key and category of a rule, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys that calibration tunes, in their canonical order.
TUNABLE = (
    "typosquat_close",
    "typosquat_warn",
    "typosquat_ascii_homoglyph",
    "typosquat_combosquat",
    "typosquat_scope_close",
    "typosquat_scope_warn",
    "metadata_new_package",
    "metadata_young_maintainer",
    "metadata_low_downloads",
    "metadata_popular_but_stale",
    "anomaly_release_burst",
    "license_changed_in_patch",
    "install_script_present",
    "install_script_base64",
    "install_script_child_process",
    "install_script_eval",
    "install_script_node_eval",
    "install_script_dynamic_require",
    "install_script_external_url",
    "cap_exec",
    "cap_dynamic_eval",
    "cap_env_read",
    "entropy_obfuscation",
    "sink_alone",
    "sink_with_obfuscation",
    "version_diff_new_script_in_patch",
    "version_diff_script_changed_in_patch",
    "version_diff_new_exec_in_patch",
    "version_diff_new_net_in_patch",
    "version_diff_new_deps_in_patch",
    "typosquat_with_install_script",
    "install_script_with_exec",
    "install_script_with_network",
    "install_script_with_obfuscation",
)

#: Emitted rules whose weight has another name.
EXACT_KEYS = {
    "anomaly_version_spike": "anomaly_release_burst",
    "license_patch_change": "license_changed_in_patch",
    "capability_exec": "cap_exec",
    "capability_dynamic_eval": "cap_dynamic_eval",
    "capability_env_read": "cap_env_read",
    "obfuscation_high_entropy": "entropy_obfuscation",
    "sink_eval": "sink_alone",
    "sink_new_function": "sink_alone",
    "sink_vm_run_this_context": "sink_alone",
    "sink_vm_run_new_context": "sink_alone",
    "sink_dynamic_require": "sink_alone",
    "version_diff_new_dependency": "version_diff_new_deps_in_patch",
}
#: Prefixes of rules that carry the hook's name.
PREFIX_KEYS = {
    "install_script_base64_decode_": "install_script_base64",
    "install_script_child_process_": "install_script_child_process",
    "install_script_eval_": "install_script_eval",
    "install_script_node_eval_": "install_script_node_eval",
    "install_script_dynamic_require_": "install_script_dynamic_require",
    "install_script_external_url_": "install_script_external_url",
    "version_diff_new_script_": "version_diff_new_script_in_patch",
    "version_diff_changed_script_": "version_diff_script_changed_in_patch",
}
#: Rules that combine findings of several layers.
COMBOS = ("typosquat_with_install_script", "install_script_with_exec", "install_script_with_network", "install_script_with_obfuscation")
#: Categories by prefix, the first that fits.
CATEGORY_PREFIXES = (
    ("typosquat_", "typosquat"),
    ("metadata_", "metadata"),
    ("license_", "metadata"),
    ("anomaly_", "anomaly"),
    ("install_script_", "install"),
    ("cap_", "capability"),
    ("capability_", "capability"),
    ("sink_", "sink"),
    ("version_diff_", "version_diff"),
)


def weight_key(rule: Column) -> Column:
    out = F.coalesce(F.create_map(*[F.lit(x) for kv in EXACT_KEYS.items() for x in kv])[rule], F.lit(None).cast("string"))
    chain = F.when(out.isNotNull(), out)
    for prefix, key in PREFIX_KEYS.items():
        chain = chain.when(rule.startswith(prefix), F.lit(key))
    return chain.otherwise(rule)


def category(rule: Column) -> Column:
    chain = F.when(rule.isin(*COMBOS), F.lit("combo"))
    for prefix, name in CATEGORY_PREFIXES:
        chain = chain.when(rule.startswith(prefix), F.lit(name))
    return chain.when(rule == "entropy_obfuscation", F.lit("entropy")).otherwise(F.lit("other"))


def default_weights(config) -> dict[str, float]:
    """The tunable keys' weights in a configuration; that of entropy is 0.30, which no setting holds."""
    one, two, three, combo = config.layer1, config.layer2, config.layer3, config.combo
    found = {
        "anomaly_release_burst": one.anomaly_version_spike_score,
        "license_changed_in_patch": one.license_patch_change_score,
        "metadata_popular_but_stale": one.metadata_popular_stale_score,
        "cap_exec": three.capability_exec_score,
        "cap_dynamic_eval": three.capability_dynamic_eval_score,
        "cap_env_read": three.capability_env_read_score,
        "entropy_obfuscation": 0.30,
        "sink_alone": three.sink_alone_score,
        "sink_with_obfuscation": three.sink_obfuscation_score,
        "version_diff_new_script_in_patch": three.version_diff_script_added_score,
        "version_diff_script_changed_in_patch": three.version_diff_script_changed_score,
        "version_diff_new_exec_in_patch": three.version_diff_cap_exec_score,
        "version_diff_new_net_in_patch": three.version_diff_cap_net_score,
        "version_diff_new_deps_in_patch": three.version_diff_new_dep_score,
    }
    for key in TUNABLE:
        if key not in found:
            section = next(s for s in (one, two, combo) if hasattr(s, key + "_score"))
            found[key] = getattr(section, key + "_score")
    return {k: float(found[k]) for k in TUNABLE}


def apply_weights(config, weights: dict[str, float]):
    """The configuration with these weights; entropy's has no setting and is dropped."""
    from parapet.config import load

    names = {
        "anomaly_release_burst": ("layer1", "anomaly_version_spike_score"),
        "license_changed_in_patch": ("layer1", "license_patch_change_score"),
        "metadata_popular_but_stale": ("layer1", "metadata_popular_stale_score"),
        "cap_exec": ("layer3", "capability_exec_score"),
        "cap_dynamic_eval": ("layer3", "capability_dynamic_eval_score"),
        "cap_env_read": ("layer3", "capability_env_read_score"),
        "sink_alone": ("layer3", "sink_alone_score"),
        "sink_with_obfuscation": ("layer3", "sink_obfuscation_score"),
        "version_diff_new_script_in_patch": ("layer3", "version_diff_script_added_score"),
        "version_diff_script_changed_in_patch": ("layer3", "version_diff_script_changed_score"),
        "version_diff_new_exec_in_patch": ("layer3", "version_diff_cap_exec_score"),
        "version_diff_new_net_in_patch": ("layer3", "version_diff_cap_net_score"),
        "version_diff_new_deps_in_patch": ("layer3", "version_diff_new_dep_score"),
    }
    tree = config.as_dict()
    for key, value in weights.items():
        if key == "entropy_obfuscation":
            continue
        section, name = names.get(key) or next((s, key + "_score") for s in ("layer1", "layer2", "combo") if key + "_score" in tree[s])
        tree[section][name] = value
    return load(env={}, **tree)


def key_order(key: Column) -> Column:
    """Canonical place of a key; others come after, by name."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(TUNABLE) for x in (k, i)])
    return F.coalesce(place[key], F.lit(999))

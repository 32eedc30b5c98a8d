"""Settings: sections of scalars, from defaults, a YAML file and environment variables."""

from __future__ import annotations

import copy
import os
from types import SimpleNamespace

#: The production defaults that results must agree with.
DEFAULTS = {
    "proxy": {"max_tarball_bytes": 524288000, "analysis_timeout_sec": 15},
    "cache": {"verdict_ttl_hours": 24, "osv_ttl_hours": 1},
    "extractor": {"max_files": 10000, "max_file_bytes": 5242880, "max_total_bytes": 104857600},
    "calibration": {"max_files": 100000, "max_file_bytes": 104857600, "max_total_bytes": 2147483648},
    "layer1": {
        "typosquat_close_distance": 1,
        "typosquat_close_score": 0.55,
        "typosquat_warn_distance": 2,
        "typosquat_warn_score": 0.30,
        "typosquat_ascii_homoglyph_score": 0.65,
        "typosquat_combosquat_score": 0.20,
        "typosquat_combosquat_min_len": 4,
        "typosquat_scope_min_packages": 3,
        "typosquat_scope_close_score": 0.55,
        "typosquat_scope_warn_score": 0.25,
        "metadata_new_package_days": 7,
        "metadata_new_package_score": 0.20,
        "metadata_young_maintainer_days": 30,
        "metadata_young_maintainer_score": 0.25,
        "metadata_single_maintainer_score": 0.05,
        "metadata_low_downloads_threshold": 100,
        "metadata_low_downloads_score": 0.05,
        "metadata_popular_threshold": 100000,
        "metadata_popular_stale_days": 365,
        "metadata_popular_stale_score": 0.15,
        "anomaly_max_versions_per_day": 5,
        "anomaly_version_spike_score": 0.20,
        "license_patch_change_score": 0.15,
    },
    "layer2": {
        "install_script_present_score": 0.20,
        "install_script_base64_score": 0.35,
        "install_script_child_process_score": 0.20,
        "install_script_eval_score": 0.15,
        "install_script_node_eval_score": 0.15,
        "install_script_dynamic_require_score": 0.10,
        "install_script_external_url_score": 0.08,
    },
    "layer3": {
        "entropy_threshold": 4.5,
        "entropy_ratio_threshold": 0.20,
        "entropy_ratio_weight": 0.3,
        "entropy_min_string_len": 64,
        "entropy_hex_min_len": 64,
        "capability_exec_score": 0.30,
        "capability_dynamic_eval_score": 0.20,
        "capability_env_read_score": 0.10,
        "version_diff_script_added_score": 0.40,
        "version_diff_script_changed_score": 0.25,
        "version_diff_cap_exec_score": 0.35,
        "version_diff_cap_net_score": 0.25,
        "version_diff_new_dep_score": 0.10,
        "version_diff_new_dep_cap": 0.35,
        "sink_alone_score": 0.20,
        "sink_obfuscation_score": 0.55,
    },
    "combo": {
        "typosquat_with_install_script_score": 0.20,
        "install_script_with_exec_score": 0.20,
        "install_script_with_network_score": 0.15,
        "install_script_with_obfuscation_score": 0.20,
    },
    "policy": {"allow_threshold": 0.30, "block_threshold": 0.70, "min_categories": 2},
    "recheck": {"enabled": True, "interval_hours": 6, "batch_size": 500, "warn_only": True},
    "siem": {"webhook_url": "", "webhook_hmac_secret": "", "buffer_size": 256},
}


class Config(SimpleNamespace):
    """config.layer1.typosquat_close_score and so on."""

    def as_dict(self) -> dict[str, dict]:
        return {k: dict(vars(v)) for k, v in vars(self).items()}


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "PROXY_", **changes: dict) -> Config:
    """Defaults, then the file, then the environment, then `changes` (section={key: value}).

    Every underscore of a variable's name separates levels, so that only keys without one can be
    set there; a name that leads nowhere changes nothing.
    """
    tree = copy.deepcopy(DEFAULTS)
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            for section, values in (yaml.safe_load(f) or {}).items():
                tree.setdefault(section, {}).update(values or {})
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(prefix):
            where = name[len(prefix) :].lower().split("_")
            if len(where) == 2 and where[1] in tree.get(where[0], {}):
                kind = type(tree[where[0]][where[1]])
                tree[where[0]][where[1]] = value.lower() in ("1", "true") if kind is bool else kind(value)
    for section, values in changes.items():
        tree.setdefault(section, {}).update(values)
    return Config(**{k: SimpleNamespace(**v) for k, v in tree.items()})


def dump(config: Config, path: str) -> None:
    """The settings as YAML."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config.as_dict(), f, sort_keys=False)

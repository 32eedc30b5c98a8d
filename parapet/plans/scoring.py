"""The staged scorer: each stage scans only what the stages before left open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.operators import code, manifest, metadata, names, policy, versions
from parapet.schema import union
from parapet.sources import archives, registry


@dataclass
class Snapshot:
    """What is known of packages: packages (pkg_id, name, version, created), and the other relations by pkg_id."""

    packages: DataFrame
    publishes: DataFrame
    maintainers: DataFrame
    downloads: DataFrame
    users: DataFrame
    advisories: DataFrame
    popular: DataFrame
    files: DataFrame
    pairs: DataFrame | None = None
    previous: DataFrame | None = None


def settled(df: DataFrame) -> DataFrame:
    """df computed once, as later stages read it more than once: a checkpoint in the cluster's shared folder, or a cache where none is set."""
    held = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    return df.checkpoint() if held.isDefined() else df.persist()


def first_layer(s: Snapshot, as_of: Column, config) -> DataFrame:
    parts = [
        names.name_signals(s.packages, s.popular, config),
        names.advisory_signals(s.packages, s.advisories),
        metadata.metadata_signals(s.packages, s.publishes, s.maintainers, s.downloads, s.users, as_of, config),
    ]
    if s.pairs is not None and "license" in s.pairs.columns:
        parts.append(metadata.license_change(s.pairs, config))
    return union(*parts)


def offline_layer(s: Snapshot, as_of: Column, config) -> DataFrame:
    """B1: the rules of the first layer that need no remote service: names, age, maintainers, release bursts, licences."""
    parts = [
        names.name_signals(s.packages, s.popular, config),
        metadata.new_package(s.packages, as_of, config),
        metadata.single_maintainer(s.maintainers, config),
        metadata.version_spike(s.publishes, as_of, config),
    ]
    if s.pairs is not None and "license" in s.pairs.columns:
        parts.append(metadata.license_change(s.pairs, config))
    return union(*parts)


def with_capabilities(pairs: DataFrame, files: DataFrame, previous: DataFrame) -> DataFrame:
    """V6: pairs whose lifecycle scripts differ, with caps and previous_caps by scans of both versions' files.

    Pairs without files of the version before are left out: nothing is known to compare with.
    """
    changed = versions.script_changes(pairs)
    of = changed.select(changed["pkg_id"].cast("string").alias("pkg_id"))
    scans = [code.capability_list(code.capabilities(code.sources(f.join(of, "pkg_id", "left_semi")))) for f in (files, previous)]
    there = previous.select(previous["pkg_id"].cast("string").alias("pkg_id")).distinct()
    empty = F.array().cast("array<string>")
    out = changed.join(there, "pkg_id", "left_semi").join(scans[0], "pkg_id", "left").join(scans[1].withColumnRenamed("caps", "previous_caps"), "pkg_id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("caps", "previous_caps")})


def later_layers(files: DataFrame, config, pairs: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Manifest rules; then, for packages they do not veto, code scans and version differences.

    previous: files of the versions before (by the pkg_id of the pair), scanned where a patch release
    changes lifecycle scripts; without them, pairs may bring caps and previous_caps.
    """
    scripts = settled(manifest.script_signals(registry.manifests(files), config))
    open_files = manifest.without_vetoed(files, scripts)
    parts = [scripts, code.code_signals(open_files, config)]
    if pairs is not None:
        rest = manifest.without_vetoed(pairs, scripts)
        parts += [versions.script_diff(rest, config), versions.dependency_diff(rest, config)]
        if previous is not None:
            parts.append(versions.capability_diff(with_capabilities(rest, open_files, previous), config))
        elif "caps" in pairs.columns:
            parts.append(versions.capability_diff(rest, config))
    return union(*parts)


def score(s: Snapshot, as_of: Column, config) -> tuple[DataFrame, DataFrame]:
    """(signals, decisions). Packages that names and metadata block are decided by these alone."""
    first = settled(first_layer(s, as_of, config))
    early = policy.decide(s.packages, first, config)
    left = settled(policy.not_blocked(s.packages.select("pkg_id"), early))
    later = later_layers(s.files.join(left, "pkg_id", "left_semi"), config, None if s.pairs is None else s.pairs.join(left, "pkg_id", "left_semi"), s.previous)
    both = settled(first.unionByName(later))
    combos = policy.combo_signals(both.join(left, "pkg_id", "left_semi"), config)
    signals = both.unionByName(combos)
    return signals, policy.decide(s.packages, signals, config)


def score_files(files: DataFrame, config, pairs: DataFrame | None = None, first: DataFrame | None = None, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, decisions) of archives, with the signals of a first layer where given, as in calibration."""
    found = later_layers(files, config, pairs, previous)
    found = settled(found if first is None else found.unionByName(first))
    signals = policy.with_combos(found, config)
    return signals, policy.decide(files.select("pkg_id").distinct(), signals, config)


def calibration_files(found: DataFrame, config) -> DataFrame:
    """B1: files of the corpus's archives (pkg_id, content) by the limits of calibration, which large samples do not break."""
    return archives.files(found, config.calibration)


def calibration_runs(corpus: DataFrame, files: DataFrame, config, strip_advisories: bool = False, known: Snapshot | None = None, as_of: Column | None = None) -> DataFrame:
    """B1 and B2: signals of a labelled corpus (pkg_id, label, osv_vulnerable), with a veto made of the label where it says so.

    files are those of calibration_files, or the archives themselves (pkg_id, content), which are then
    unpacked so. Archives that cannot be read give no runs: see dropped(). known: names and metadata of
    the corpus as of a time, by which the first layer's offline rules are run too; packages without
    metadata have no rows in its other relations.
    """
    if "path" not in files.columns:
        files = calibration_files(files, config)
    sound = files.filter("error IS NULL")
    first = None
    if known is not None:
        first = offline_layer(known, as_of, config).join(sound.select("pkg_id").distinct(), "pkg_id", "left_semi")
    signals, _ = score_files(sound, config, known.pairs if known is not None else None, first, known.previous if known is not None else None)
    if strip_advisories:
        return signals
    hit = corpus.filter("osv_vulnerable").join(sound.select("pkg_id").distinct(), "pkg_id", "left_semi").selectExpr("pkg_id", "pkg_id as name", "'' as version")
    return signals.unionByName(names.advisory_signals(hit, hit.select("name", "version")))


def dropped(files: DataFrame) -> DataFrame:
    """B2: archives that were refused, and why."""
    return files.filter("error IS NOT NULL").select("pkg_id", "error").distinct()



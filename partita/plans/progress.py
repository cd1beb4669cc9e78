"""Progress and dataset cards as text."""

from __future__ import annotations

from typing import Any


def duration(seconds: float) -> str:
    """Seconds below a minute, then minutes and seconds, then hours and minutes."""
    whole = int(round(seconds))
    if whole < 60:
        return f"{whole}s"
    if whole < 3600:
        return f"{whole // 60}m{whole % 60:02}s"
    return f"{whole // 3600}h{whole % 3600 // 60:02}m"


def progress_line(done: int, total: int, seconds: float) -> str:
    share = 100 * done / total if total else 100.0
    left = seconds / done * (total - done) if done else 0.0
    return f"{done}/{total} ({share:.1f} %) in {duration(seconds)}, {duration(left)} left"


def dataset_card(manifest: dict[str, Any], fetched: dict[str, int] | None = None, assembly: bool = True) -> str:
    """Markdown: what the dataset is, how many entries each split has and how many files are there, and where they are."""
    lines = [f"# Dataset {manifest['dataset_version']}", "", "| split | entries | components | sequence sets | files |", "|---|---|---|---|---|"]
    lines += [f"| {s} | {c['entries']} | {c['components']} | {c['sequence_groups']} | {(fetched or {}).get(s, 0)} |" for s, c in manifest["counts"].items()]
    lines += ["", f"Settings hash `{manifest['config_hash']}`; no key is shared between splits.", ""]
    lines += [f"Files (`{'biological assembly' if assembly else 'as deposited'}`) lie in `structures/<split>/<shard>/`; `index` (Parquet) and `index.jsonl` have a row for each with path, SHA-256, cluster, classes, tiers and conditioning targets.", ""]
    return "\n".join(lines)

"""Decisions of the driver before a job starts: which datasets take part, what may be run, what a model's revision is, what is there."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping

_REVISION = re.compile(r"[0-9a-fA-F]{40}")


def main_datasets(configs: Mapping[str, Mapping]) -> list[str]:
    """Names of datasets for the main manifest: held-out ones and those that are still to be built stay out."""
    return [name for name, c in configs.items() if c.get("role", "core") != "held_out" and c.get("construction_status") != "pending"]


def authorise(policy: Mapping | None, limit: int | None, dataset: str | None, dry_run: bool = False) -> None:
    """An error unless the policy allows the run: all of it, a small number of rows, or one whole dataset by name."""
    if dry_run:
        return
    if not isinstance(policy, Mapping):
        raise PermissionError("there is no policy for this run")
    if policy.get("full_core_approved") is True:
        return
    if policy.get("staged_checks_approved") is not True:
        raise PermissionError("checks in stages are not approved")
    most, names = policy.get("staged_max_examples"), policy.get("staged_full_dataset_allowlist", [])
    small = type(most) is int and most > 0 and limit is not None and limit <= most
    whole = isinstance(names, list) and limit is None and dataset in map(str, names)
    if not (small or whole):
        raise PermissionError(f"only runs of at most {most} rows or of one of the datasets {names} are approved")


def metadata_revision(text: str) -> str | None:
    """The commit that a download's metadata names: its first line that isn't empty, if that is one."""
    first = next((line.strip() for line in text.splitlines() if line.strip()), "")
    return first.lower() if _REVISION.fullmatch(first) else None


def resolve_revision(path: str, metadata: Iterable[str]) -> tuple[str, str | None]:
    """RESOLVED with the commit, AMBIGUOUS or UNRESOLVED, from the path's parts and the texts of metadata files."""
    found = {p.lower() for p in path.split(os.sep) if _REVISION.fullmatch(p)} | {r for t in metadata if (r := metadata_revision(t))}
    if len(found) == 1:
        return "RESOLVED", found.pop()
    return ("AMBIGUOUS" if found else "UNRESOLVED"), None


def missing_artifacts(root: str, required: Iterable[str]) -> list[str]:
    """Of the required files or folders those that are lacking or empty."""

    def filled(path: str) -> bool:
        return bool(os.listdir(path)) if os.path.isdir(path) else os.path.isfile(path) and os.path.getsize(path) > 0

    return [r for r in required if not filled(os.path.join(root, r))]

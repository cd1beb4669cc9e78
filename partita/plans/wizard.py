"""Settings files from a template: values change, comments and order stay."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path
from typing import Any

from partita.sources.documents import write_text


def rewrite(text: str, values: dict[str, Any]) -> str:
    """``text`` with the values of top-level ``key: value`` lines replaced; a key that it lacks is an error."""
    left, out = dict(values), []
    for line in text.splitlines(keepends=True):
        m = re.match(r"([A-Za-z_]\w*)(\s*:\s*)([^#\n]*?)(\s*(?:#.*)?\n?)$", line)
        if m and m[1] in left:
            line = f"{m[1]}{m[2].rstrip()} {json.dumps(left.pop(m[1]), default=str)}{m[4]}"
        out.append(line)
    if left:
        raise ValueError(f"the template lacks {', '.join(sorted(left))}")
    return "".join(out)


def ask(question: str, parse: Callable[[str], Any], default: Any, prompt: Callable[[str], str] = input) -> Any:
    """An answer that parses; an empty one is the default, a bad one is asked again."""
    while True:
        said = prompt(f"{question} [{default}]: ").strip()
        if not said:
            return default
        try:
            return parse(said)
        except ValueError as e:
            print(f"  {e}")


def positive(text: str) -> float:
    value = float(text)
    if value <= 0:
        raise ValueError("a positive number, please")
    return value


def fractions(text: str) -> dict[str, float]:
    parts = [float(x) for x in re.split(r"[\s,/]+", text)]
    if len(parts) != 3 or abs(sum(parts) - 1) > 1e-9:
        raise ValueError("three shares that sum to 1, please")
    return dict(zip(("train", "val", "test"), parts, strict=True))


def one_of(*names: str) -> Callable[[str], str]:
    def parse(text: str) -> str:
        if text not in names:
            raise ValueError(f"one of {', '.join(names)}, please")
        return text

    return parse


def run_init(template: str, out: str | Path, prompt: Callable[[str], str] = input) -> Path:
    """Ask for the settings that most builds change and write the file."""
    values = {
        "resolution_max_A": ask("loosest resolution", positive, 3.5, prompt),
        "split_fractions": ask("train/val/test", fractions, {"train": 0.8, "val": 0.1, "test": 0.1}, prompt),
        "split_strategy": ask("strategy", one_of("hash", "balanced", "maximal"), "maximal", prompt),
        "structural_clustering": ask("merge on", one_of("off", "cath", "ecod", "scop2", "pfam", "interpro", "union", "all"), "all", prompt),
        "split_salt": ask("salt", str, "salt-1", prompt),
    }
    return write_text(out, rewrite(template, values))

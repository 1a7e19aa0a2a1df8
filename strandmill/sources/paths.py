"""Input resolution: files, folders and `.list` manifests to sequence files."""

from __future__ import annotations

import logging
import os

EXTENSIONS = ("fasta", "fa", "fastq", "fq", "gz")


_LOG = logging.getLogger(__name__)


def has_sequence_extension(path: str) -> bool:
    """Whether the last extension is one of a sequence file; case matters."""
    return os.path.splitext(path)[1].removeprefix(".") in EXTENSIONS


def _listed(path: str) -> list[str]:
    """The existing sequence files that a manifest names, one for each line; an existing file without extension is an error."""
    out = []
    with open(path) as lines:
        for line in lines:
            entry = line.strip()
            if not entry or not os.path.exists(entry):
                continue
            if not os.path.splitext(entry)[1]:
                raise ValueError(f"{entry}: file without extension")
            if has_sequence_extension(entry):
                out.append(entry)
    return out


def resolve(paths: str | list[str], check_extension: bool = True) -> list[str]:
    """Expands folders (their own sequence files, not deeper; what is skipped is logged), `.list` manifests and files, in the given order.

    A missing path is an error; so is, with `check_extension`, a file with another extension or with none.
    """
    out: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        if os.path.isdir(path):
            for inside in sorted(os.path.join(path, name) for name in os.listdir(path)):
                if os.path.isfile(inside) and has_sequence_extension(inside):
                    out.append(inside)
                else:
                    kind = "file without extension" if not os.path.splitext(inside)[1] else "file with another extension"
                    _LOG.warning("skipping %s: %s", "directory" if os.path.isdir(inside) else kind, inside)
        elif not os.path.exists(path):
            raise FileNotFoundError(path)
        elif path.endswith(".list"):
            out += _listed(path)
        elif check_extension and not has_sequence_extension(path):
            kind = "unknown extension" if os.path.splitext(path)[1] else "file without extension"
            raise ValueError(f"{path}: {kind}")
        else:
            out.append(path)
    return out

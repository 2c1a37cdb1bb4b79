"""Outputs that readers see all together or not at all.

Every run writes its outputs below a folder of its own. Only when all are there is the folder
published, by one small file. Readers take the newest folder published, so a run that fails
between two outputs changes nothing for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from .files import delete, files_in, read_small, write_once


def publish(folder: str, outputs: Mapping[str, Callable[[str], None]]) -> str:
    """Write a new version, each output by its function of a path; gives the version's folder.

    Of versions published at the same time readers take the same one. What a failed run has
    written is removed.
    """
    version = f"{folder}/versions/{uuid.uuid4().hex}"
    try:
        for name, write in outputs.items():
            write(f"{version}/{name}")
    except BaseException:
        delete(version)
        raise
    names = _published(folder)
    number = int(names[-1].split("-")[0]) + 1 if names else 0
    place = f"{folder}/published/{number:012d}-{version.rsplit('/', 1)[1]}"
    write_once(place, json.dumps({"version": version, "outputs": list(outputs)}))
    return version


def current(folder: str, output: str) -> str:
    """Where the newest version has an output; raises where there is none."""
    for name in reversed(_published(folder)):
        entry = json.loads(read_small(f"{folder}/published/{name}"))
        if output not in entry["outputs"]:
            raise ValueError(f"the newest version in {folder} has no {output}")
        return f"{entry['version']}/{output}"
    raise FileNotFoundError(f"nothing published in {folder}")


def remove_old(folder: str, keep: int = 2) -> int:
    """Remove all published versions but the newest ones; how many went.

    Their entries go first, so that no reader is sent to a version half removed.
    """
    if keep < 1:
        raise ValueError("the newest version has to stay")
    old = _published(folder)[:-keep]
    for name in old:
        place = f"{folder}/published/{name}"
        version = json.loads(read_small(place))["version"]
        delete(place)
        delete(version)
    return len(old)


def _published(folder: str) -> list[str]:
    try:
        names = [file.rsplit("/", 1)[1] for file in files_in(f"{folder}/published")]
    except FileNotFoundError:
        return []
    return [name for name in names if not name.endswith(".unfinished")]

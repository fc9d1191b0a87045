"""Lines of a cache that tasks commit while a job runs.

A journal is a folder that all executors share (a path, or an address that pyarrow's file systems know). Each task has
a folder in it, named by the run and by the first key of its range of work, and puts files of JSON lines there, each
under a hidden name first and then renamed, so a reader sees whole files only. A later attempt of the task finds what
earlier ones committed. Lines carry their time; of several with one key the last counts.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyarrow import fs


class Journal:
    def __init__(self, folder: str, every: int = 20, seconds: float = 10.0, run: str | None = None):
        """Commits come after `every` lines or so many seconds, whichever is first; a run's name is its own."""
        self.folder, self.every, self.seconds, self.run = folder.rstrip("/"), every, seconds, run or uuid.uuid4().hex[:12]

    def of_range(self, first: str, attempt: int) -> Lines:
        return Lines(self, hashlib.sha256(first.encode()).hexdigest()[:16], attempt)


class Lines:
    """What one attempt of a task adds."""

    def __init__(self, journal: Journal, name: str, attempt: int):
        self.journal, self.attempt, self.count, self.held, self.since = journal, attempt, 0, [], time.monotonic()
        self.system, root = fs.FileSystem.from_uri(journal.folder) if "://" in journal.folder else (fs.LocalFileSystem(), journal.folder)
        self.place = f"{root}/{journal.run}/{name}"

    def earlier(self) -> dict[str, dict]:
        """Rows that earlier attempts of this task committed, but for errors."""
        found: dict[str, tuple[float, dict]] = {}
        for info in self.system.get_file_info(fs.FileSelector(self.place, allow_not_found=True)):
            if info.base_name[0] in "._":
                continue
            with self.system.open_input_stream(info.path) as f:
                for row in map(json.loads, f.read().splitlines()):
                    if row["error"] is None and row["at"] >= found.get(row["key"], (0, {}))[0]:
                        found[row["key"]] = row["at"], row
        return {k: {c: v for c, v in row.items() if c != "at"} for k, (_, row) in found.items()}

    def add(self, row: dict) -> None:
        self.held.append(json.dumps(row | {"at": time.time()}, ensure_ascii=False))
        if len(self.held) >= self.journal.every or time.monotonic() - self.since > self.journal.seconds:
            self.commit()

    def commit(self) -> None:
        if self.held:
            if not self.count:
                self.system.create_dir(self.place, recursive=True)
            name = f"{self.attempt}-{self.count:06d}-{uuid.uuid4().hex[:8]}.jsonl"
            with self.system.open_output_stream(f"{self.place}/_{name}") as f:
                f.write(("\n".join(self.held) + "\n").encode())
            self.system.move(f"{self.place}/_{name}", f"{self.place}/{name}")
            self.count += 1
        self.held, self.since = [], time.monotonic()

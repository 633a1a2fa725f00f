"""Output folders as files: the contract that transactions need, over any file system that pyarrow opens."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs

CHUNK = 1 << 20


def located(path: str):
    """The file system of a path or URI, and the path in it; local names are taken as they are, whatever a URI would escape."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


class Outputs:
    """The folders under one root, by relative names.  Objects travel to executors as their address alone."""

    def __init__(self, uri: str):
        self.uri = uri
        self._open()

    def _open(self):
        self.fs, self.root = pafs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def __getstate__(self):
        return self.uri

    def __setstate__(self, uri):
        self.uri = uri
        self._open()

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def kind(self, *parts: str) -> pafs.FileType:
        return self.fs.get_file_info(self.at(*parts)).type

    def exists(self, *parts: str) -> bool:
        return self.kind(*parts) != pafs.FileType.NotFound

    def names(self, *parts: str, folders: bool = False) -> list[str]:
        """The names of the files (or folders) right in a folder, by lower-cased name; none where it does not exist."""
        want = pafs.FileType.Directory if folders else pafs.FileType.File
        found = self.fs.get_file_info(pafs.FileSelector(self.at(*parts), allow_not_found=True))
        return sorted((f.base_name for f in found if f.type == want), key=lambda n: (n.lower(), n))

    def read(self, *parts: str) -> bytes:
        with self.fs.open_input_stream(self.at(*parts)) as f:
            return f.read()

    def write(self, data: bytes, *parts: str) -> None:
        """A whole file, under its name only once it is complete."""
        folder, name = self.at(*parts).rsplit("/", 1)
        self.fs.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, self.at(*parts))

    def create(self, data: bytes, *parts: str, settle_seconds: float = 0.2) -> bool:
        """Writes a file that is not there yet; whether it was this call that made it, of all that try.

        A local or mounted file system makes one of them win.  A store without exclusive creation is asked twice: each writes
        if nothing is there, waits, and reads back whose bytes have stayed; data is then to differ between callers.
        """
        folder = self.at(*parts).rsplit("/", 1)[0]
        self.fs.create_dir(folder, recursive=True)
        if isinstance(self.fs, pafs.LocalFileSystem):
            try:
                f = os.open(self.at(*parts), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(f, "wb") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
            return True
        if self.exists(*parts):
            return False
        self.write(data, *parts)
        time.sleep(settle_seconds)
        return self.read(*parts) == data

    def age(self, *parts: str) -> float | None:
        """Seconds since a file was last written; null if there is none."""
        info = self.fs.get_file_info(self.at(*parts))
        return None if info.type == pafs.FileType.NotFound else time.time() - info.mtime_ns / 1e9

    def copy(self, source: tuple[str, ...], target: tuple[str, ...]) -> str:
        """Copies a file in pieces; the SHA-256 of what was read."""
        self.fs.create_dir(self.at(*target).rsplit("/", 1)[0], recursive=True)
        digest = hashlib.sha256()
        with self.fs.open_input_stream(self.at(*source)) as i, self.fs.open_output_stream(self.at(*target)) as o:
            while part := i.read(CHUNK):
                digest.update(part)
                o.write(part)
        return digest.hexdigest()

    def fingerprint(self, *parts: str) -> tuple[str, int]:
        digest, size = hashlib.sha256(), 0
        with self.fs.open_input_stream(self.at(*parts)) as f:
            while part := f.read(CHUNK):
                digest.update(part)
                size += len(part)
        return digest.hexdigest(), size

    def move(self, old: str, new: str) -> None:
        self.fs.move(self.at(old), self.at(new))

    def delete(self, *parts: str) -> None:
        kind = self.kind(*parts)
        if kind == pafs.FileType.Directory:
            self.fs.delete_dir(self.at(*parts))
        elif kind == pafs.FileType.File:
            self.fs.delete_file(self.at(*parts))

    def lock(self, name: str, stale_seconds: float = 12 * 3600) -> RunLock:
        return RunLock(self, name, stale_seconds)


class RunLock:
    """One run at a time: a file that only one run can create, with a token of its own.

    A lock older than stale_seconds is taken over, by the one run that can create the mark of that; a run deletes no lock but
    its own, so one that was overtaken leaves its successor's alone.
    """

    def __init__(self, outputs: Outputs, name: str, stale_seconds: float = 12 * 3600):
        self.outputs, self.name, self.stale, self.token = outputs, name, stale_seconds, None

    def _held(self) -> dict | None:
        try:
            told = json.loads(self.outputs.read(self.name))
        except FileNotFoundError:
            return None
        except ValueError:  # being written, or cut short
            told = {}
        age = self.outputs.age(self.name)
        started = told.get("started_at", time.time() - (age or 0))
        return {"token": told.get("token", "unreadable"), "stale": time.time() - started > self.stale}

    def __enter__(self):
        token = uuid.uuid4().hex
        told = json.dumps({"token": token, "started_at": time.time()}).encode()
        if not self.outputs.create(told, self.name):
            held = self._held()
            mark = f"{self.name}.stale-{held['token']}" if held else None
            if held and not (held["stale"] and self.outputs.create(token.encode(), mark)):
                raise RuntimeError(f"another run holds {self.name}")
            now = self._held()
            if now and now["token"] == held["token"] if held else False:  # else it was taken over before the mark was made
                self.outputs.delete(self.name)
            won = self.outputs.create(told, self.name)
            if mark:
                self.outputs.delete(mark)
            if not won:
                raise RuntimeError(f"another run holds {self.name}")
        self.token = token
        return self

    def __exit__(self, *_):
        held = self._held()
        if held and held["token"] == self.token:
            self.outputs.delete(self.name)
        self.token = None


class Once:
    """Work with effects that is done once for each key of a run, however often tasks ask: a log of claims and outcomes.

    The first to ask creates the key's claim, works, and writes the outcome; whoever asks later - a second action over the same
    plan, a retried or a speculative task - is given the outcome, and waits for it while the claim is alive.  A claim lives
    as long as its worker touches it; if that has stopped for lease_seconds (the executor is lost), the next to create its
    successor works anew, and is told so: work is to undo what an attempt that died has left.
    """

    def __init__(self, outputs: Outputs, run_id: str | None = None, folder: tuple[str, ...] = ("_manifests", "runs"), lease_seconds: float = 60):
        self.outputs, self.run_id, self.folder, self.lease = outputs, run_id or uuid.uuid4().hex, folder, lease_seconds

    def _at(self, key: str, what: str) -> tuple[str, ...]:
        return (*self.folder, self.run_id, f"{hashlib.sha256(key.encode()).hexdigest()}.{what}")

    def outcome(self, key: str) -> dict | None:
        at = self._at(key, "json")
        return json.loads(self.outputs.read(*at)) if self.outputs.exists(*at) else None

    def do(self, key: str, work: Callable[[bool], dict]) -> dict:
        """The outcome of work(again) for key: what it returns, as JSON has it, or {"error_type", "error"} of what it raised."""
        turn, token = 0, uuid.uuid4().hex.encode()
        while True:
            if (told := self.outcome(key)) is not None:
                return told
            claim = self._at(key, f"claim{turn}")
            if self.outputs.create(token, *claim):
                return self._work(key, claim, token, turn > 0, work)
            age = self.outputs.age(*claim)
            if age is not None and age > self.lease:
                turn += 1
            else:
                time.sleep(min(1.0, self.lease / 10))

    def _work(self, key, claim, token, again, work) -> dict:
        done = threading.Event()

        def touch():
            while not done.wait(self.lease / 4):
                self.outputs.write(token, *claim)

        alive = threading.Thread(target=touch, daemon=True)
        alive.start()
        try:
            told = {"outcome": work(again)}
        except Exception as e:  # whatever fails is an outcome too
            told = {"error_type": type(e).__name__, "error": str(e)}
        finally:
            done.set()
            alive.join()
        self.outputs.write(json.dumps(told, ensure_ascii=False, default=str).encode(), *self._at(key, "json"))
        return told

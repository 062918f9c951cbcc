"""Raw landing: files appear whole or not at all, complete ones are not fetched again, payloads are checked before they land."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path

from .readers import HOURLY_KEYS
from .rest import KeyRange, fetch, pages


def land(path: str | Path, content: Callable[[], bytes], complete: Callable[[bytes], bool] = bool) -> str:
    """Writes ``content()`` to ``path`` by way of a ``.part`` file, unless a complete file is there; returns its SHA-256."""
    path = Path(path)
    if path.exists() and complete(data := path.read_bytes()):
        return hashlib.sha256(data).hexdigest()
    data = content()
    if not complete(data):
        raise ValueError(f"{path.name} isn't complete")
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.part")
    with part.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    part.replace(path)
    return hashlib.sha256(data).hexdigest()


def land_month(folder: str | Path, base: str, field: str, start: str, end: str, key: str, page: int, get=fetch) -> list[Path]:
    """A month's pages, one file each, with a manifest of their rows and hashes; the month is there when its manifest is."""
    folder = Path(folder)
    listing = folder / "manifest.json"
    if not listing.exists():
        files = []
        for k, rows in enumerate(pages(base, field, key, KeyRange(start, end), page, get)):
            body = json.dumps(rows).encode()
            files.append({"file": f"page-{k:05d}.json", "rows": len(rows), "sha256": land(folder / f"page-{k:05d}.json", lambda body=body: body)})
        land(listing, lambda: json.dumps({"start": start, "end": end, "files": files}).encode())
    return [folder / f["file"] for f in json.loads(listing.read_text())["files"]]


def weather_complete(body: bytes, hours: int | None = None, timezone: str = "America/New_York") -> bool:
    """Whether a weather payload has all hourly arrays, equally long and not empty, in the time zone."""
    try:
        payload = json.loads(body)
        sizes = {len(payload["hourly"][k]) for k in HOURLY_KEYS}
        return payload["timezone"] == timezone and len(sizes) == 1 and min(sizes) > 0 and (hours is None or sizes == {hours})
    except (ValueError, KeyError, TypeError):
        return False

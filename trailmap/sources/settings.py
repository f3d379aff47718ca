"""Where a project and its settings are: configuration files, typed environment values, versions, logs."""

from __future__ import annotations

import json
import logging
import os
import secrets
import time
from logging.handlers import RotatingFileHandler
from pathlib import Path

# fixed values: levels from the gravest, and what counts as true
LEVELS = {"error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG, "trace": 5}
TRUE = ("1", "true", "yes", "on")
NO_VERSION = "0.0.0"


def found_above(start: str | Path, name: str) -> Path | None:
    """The nearest file of this name in a folder or one above it."""
    here = Path(start).resolve()
    return next((d / name for d in (here, *here.parents) if (d / name).exists()), None)


def tsconfig(root: str | Path) -> Path:
    """A project's configuration; raises ValueError, which a surface answers with 400, where it has none."""
    path = Path(root) / "tsconfig.json"
    if not path.exists():
        raise ValueError(f"no tsconfig.json in {root}")
    return path


def dotenv_path(environ: dict[str, str] | None = None, cwd: str | Path | None = None) -> Path | None:
    """The file of settings: the one that ENV_FILE names, if it exists, else the nearest above the working folder."""
    env, here = os.environ if environ is None else environ, Path(cwd or os.getcwd())
    if env.get("ENV_FILE") and (here / env["ENV_FILE"]).exists():
        return (here / env["ENV_FILE"]).resolve()
    return found_above(here, ".env")


def with_dotenv(environ: dict[str, str], path: Path | None) -> dict[str, str]:
    """Settings with a file's laid under them, or over them if ENV_OVERRIDE is true."""
    if path is None:
        return dict(environ)
    said = {}
    for line in path.read_text(encoding="utf-8").splitlines():
        key, eq, value = line.partition("=")
        key = key.strip().removeprefix("export ").strip()
        if eq and key and not key.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            said[key] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return dict(environ) | said if flag(environ, "ENV_OVERRIDE", False) else said | dict(environ)


def number(environ: dict[str, str], name: str, default: float) -> float:
    try:
        return float(environ[name]) if environ.get(name) else default
    except ValueError:
        return default


def word(environ: dict[str, str], name: str, default: str) -> str:
    return environ.get(name) or default


def flag(environ: dict[str, str], name: str, default: bool) -> bool:
    return environ[name].strip().lower() in TRUE if environ.get(name) else default


def resolved(path: str | None, fallback: str, start: str | Path) -> Path:
    """A path as it is if absolute, else below the folder of the nearest .env above `start`, else below the working folder."""
    env = found_above(start, ".env")
    raw = (path or "").strip() or fallback
    return (Path(raw) if os.path.isabs(raw) else (env.parent if env else Path.cwd()) / raw).resolve()


def version(root: str | Path) -> str:
    """The version that package.json states."""
    try:
        return str(json.loads((Path(root) / "package.json").read_text(encoding="utf-8"))["version"])
    except (OSError, ValueError, KeyError, TypeError):
        return NO_VERSION


def request_id() -> str:
    """R-, the time in base 36, and some hexadecimal digits: short, and sorted by time."""
    n, digits = int(time.time() * 1000), ""
    while n:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return f"R-{digits}-{secrets.token_hex(3)}"


def log_to(path: str | Path, level: str = "info", most_bytes: int = 5 << 20, files: int = 5) -> logging.Logger:
    """The library's log, to a file that is renamed and begun anew when it is full."""
    logging.addLevelName(LEVELS["trace"], "TRACE")
    log = logging.getLogger("trailmap")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    handler = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=files, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(LEVELS[level])
    return log

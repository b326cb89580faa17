"""A workspace on disk: its settings, its files, checks of these, and batches of questions.

These run on the driver; a workspace is one file of settings and a few small ones beside it.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields
from datetime import date
from pathlib import Path

#: The settings' file, the places of inputs and outputs, and ways to retrieve.
SETTINGS, INPUTS, OUTPUTS = "tidewrack.toml", "data", "outputs"
BACKENDS = ("bm25", "dense", "hybrid", "lexical")
#: The environment's names for a workspace, a model's address and a model.
ENV_WORKSPACE, ENV_URL, ENV_MODEL = "TIDEWRACK_WORKSPACE", "TIDEWRACK_BASE_URL", "TIDEWRACK_MODEL"


class WorkspaceError(Exception):
    """Any error that a user can mend."""


class ConfigError(WorkspaceError):
    """Settings are missing or wrong."""


class DocumentError(WorkspaceError):
    """Documents can't be read."""


class ClientError(WorkspaceError):
    """A model can't be asked."""


@dataclass(frozen=True)
class Period:
    label: str
    start: date
    end: date


@dataclass(frozen=True)
class Space:
    name: str
    description: str = ""
    timezone: str = "UTC"
    periods: tuple[Period, ...] = ()


@dataclass(frozen=True)
class Runtime:
    base_url: str = "http://127.0.0.1:18080"
    model: str = "local-model"
    timeout_seconds: int = 120
    temperature: float = 0.2
    max_tokens: int = 512


@dataclass(frozen=True)
class Rag:
    index_path: Path
    top_k: int = 8
    max_fact_chars: int = 500
    backend: str = "bm25"
    token_config: Path | None = None


@dataclass(frozen=True)
class Config:
    path: Path
    root: Path
    workspace: Space
    rag: Rag
    system_prompt: Path
    runtime: Runtime = field(default_factory=Runtime)
    evals: dict[str, Path] = field(default_factory=dict)


def _part(kind: type, told: dict, where: str):
    known = {f.name for f in fields(kind)}
    try:
        return kind(**{k: v for k, v in told.items() if k in known})
    except TypeError as e:
        raise ConfigError(f"[{where}]: {e}") from e


def _in(root: Path, path: str | os.PathLike) -> Path:
    p = Path(path).expanduser()
    return p if p.is_absolute() else (root / p).resolve()


def load_config(path: str | os.PathLike | None, environ: dict[str, str] | None = None) -> Config:
    """Settings of a workspace; each thing that is missing or out of its range is an error of its own."""
    environ = os.environ if environ is None else environ
    if path is None or not str(path).strip():
        raise ConfigError("a path of settings is needed")
    path = Path(path).expanduser().resolve()
    if not path.exists():
        raise ConfigError(f"no settings at {path}")
    try:
        told = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    for part in ("workspace", "rag", "prompts"):
        if not isinstance(told.get(part), dict):
            raise ConfigError(f"missing section [{part}]")
    space = dict(told["workspace"])
    try:
        space["periods"] = tuple(Period(p["label"], _day(p["start"]), _day(p["end"])) for p in space.get("periods", ()))
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"[workspace] periods: {e}") from e
    root = path.parent
    rag = _part(Rag, told["rag"], "rag")
    runtime = _part(Runtime, told.get("runtime", {}) | {k: v for k, n in (("base_url", ENV_URL), ("model", ENV_MODEL)) if (v := environ.get(n))}, "runtime")
    if rag.backend not in BACKENDS:
        raise ConfigError(f"[rag] backend: {rag.backend}")
    for where, name, value, low, high in (("rag", "top_k", rag.top_k, 1, None), ("rag", "max_fact_chars", rag.max_fact_chars, 1, None), ("runtime", "timeout_seconds", runtime.timeout_seconds, 1, None), ("runtime", "max_tokens", runtime.max_tokens, 1, None), ("runtime", "temperature", runtime.temperature, 0, 2)):
        if isinstance(value, bool) or not isinstance(value, int | float) or value < low or (high is not None and value > high):
            raise ConfigError(f"[{where}] {name}: {value}")
    if "system" not in told["prompts"]:
        raise ConfigError("[prompts]: system is missing")
    whole = Rag(_in(root, rag.index_path), rag.top_k, rag.max_fact_chars, rag.backend, _in(root, rag.token_config) if rag.token_config else None)
    return Config(path, root, _part(Space, space, "workspace"), whole, _in(root, told["prompts"]["system"]), runtime, {k: _in(root, v) for k, v in told.get("evals", {}).items()})


def _day(x: date | str) -> date:
    return x if isinstance(x, date) else date.fromisoformat(x)


def discover(argument: str | None = None, environ: dict[str, str] | None = None, cwd: Path | None = None) -> Path:
    """The settings that are named, else those of the environment, else the nearest above the working folder."""
    environ = os.environ if environ is None else environ
    for named in (argument, environ.get(ENV_WORKSPACE)):
        if named:
            p = Path(named).expanduser()
            return p / SETTINGS if p.is_dir() else p
    here = (cwd or Path.cwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / SETTINGS).exists():
            return folder / SETTINGS
    raise ConfigError("no workspace here or above; name one")


def _below(path: str, head: str) -> str | None:
    flat = path.replace("\\", "/").removeprefix("/")
    return flat.removeprefix(head + "/") if flat.startswith(head + "/") else None


def _there(path: Path) -> bool:
    """Whether the file is there; one in a folder that can't be entered isn't."""
    try:
        return path.exists()
    except OSError:
        return False


def input_path(path: str, root: Path | None = None, cwd: Path | None = None) -> Path:
    """The file itself if it is there, else that of the workspace's data, else of the working folder's."""
    literal = Path(path).expanduser()
    if _there(literal):
        return literal.resolve()
    rest = _below(path, INPUTS) or path
    if root and _there(root / INPUTS / rest):
        return (root / INPUTS / rest).resolve()
    return ((cwd or Path.cwd()) / INPUTS / rest).resolve()


def output_path(path: str, root: Path | None = None, prefer_cwd: bool = False, cwd: Path | None = None) -> Path:
    """A place under the workspace's outputs, or the working folder's; other absolute paths stay.  Its folder is made."""
    rest = _below(path, OUTPUTS)
    if rest is None and Path(path).expanduser().is_absolute():
        out = Path(path).expanduser().resolve()
    else:
        base = root if root and not prefer_cwd else (cwd or Path.cwd())
        out = (base / OUTPUTS / (rest or path)).resolve()
    out.parent.mkdir(parents=True, exist_ok=True)
    return out


def system_prompt(config: Config) -> str:
    try:
        return config.system_prompt.read_text(encoding="utf-8").strip()
    except OSError as e:
        raise ConfigError(f"no system prompt: {e}") from e


def token_config(path: Path | None, warn: Callable[[str], None] = lambda m: print(m, file=sys.stderr)) -> dict | None:
    """Compounds and aliases of a JSON file; without a readable one a warning, and none."""
    if path is None:
        return None
    try:
        told = json.loads(path.read_text(encoding="utf-8"))
        return told if isinstance(told, dict) else None
    except (OSError, ValueError) as e:
        warn(f"token settings ignored: {e}")
        return None


def missing_files(config: Config) -> list[str]:
    """What the settings name and isn't there."""
    named = {"index": config.rag.index_path, "system prompt": config.system_prompt, **{f"eval {k}": p for k, p in config.evals.items()}}
    return [f"{what} not found: {p}" for what, p in named.items() if not p.exists()]


@dataclass(frozen=True)
class Check:
    name: str
    errors: tuple[str, ...] = ()
    code: int = 1

    @property
    def status(self) -> str:
        return "fail" if self.errors else "ok"


def rollup(checks: Iterable[Check]) -> dict:
    """Status, exit code and errors of several checks: the first that fails gives the code."""
    checks = list(checks)
    code = next((c.code for c in checks if c.errors), 0)
    return {"status": "ok" if code == 0 else "fail", "exit_code": code, "errors": [e for c in checks for e in c.errors], "components": {c.name: {"status": c.status, "errors": list(c.errors)} for c in checks}}


def validate(path: str | None, environ: dict[str, str] | None = None) -> tuple[Config | None, Check]:
    try:
        config = load_config(path, environ)
    except ConfigError as e:
        return None, Check("workspace", (str(e),))
    return config, Check("workspace", tuple(missing_files(config)))


def doctor(spark, path: str | None, reachable: Callable[[str], str | None] = lambda url: None, environ: dict[str, str] | None = None) -> dict:
    """Checks of the settings, the documents and the model's server (``reachable`` gives an error or none)."""
    from .sources.jsonl import health

    config, first = validate(path, environ)
    if config is None or not config.rag.index_path.exists():
        second = Check("docs", ("no index to check",))
    else:
        row = health(spark, str(config.rag.index_path)).first().asDict()
        second = Check("docs", tuple(f"{row[k]} documents: {k}" for k in ("invalid", "duplicate", "empty") if row[k]) or (() if row["total"] else ("no documents",)))
    error = reachable(config.runtime.base_url) if config else "no settings"
    return rollup([first, second, Check("model", (error,) if error else (), 3)])


def write_answers(rows: Iterable[dict], path: Path, provenance: bool = False) -> None:
    """One JSON array of user and model in the order of the questions, and beside it how each was made.

    All rows are checked before anything is written: each needs an answer.
    """
    rows = sorted(rows, key=lambda r: r["index"])
    bad = [r["index"] for r in rows if not (isinstance(r.get("question"), str) and isinstance(r.get("model"), str) and r["model"].strip())]
    if bad:
        raise WorkspaceError(f"no answer for {bad}")
    dump = lambda p, x: p.write_text(json.dumps(x, indent=2, ensure_ascii=False), encoding="utf-8")
    dump(path, [{"user": r["question"], "model": r["model"]} for r in rows])
    if provenance:
        dump(path.with_suffix(".provenance.json"), [{"index": r["index"], "mode": r["mode"], "error": r.get("error") or ""} for r in rows])


def check_answers(path: Path) -> list[int]:
    """Places of rows of an answers' file without an answer."""
    return [k for k, r in enumerate(json.loads(path.read_text(encoding="utf-8"))) if not str(r.get("model") or "").strip()]


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def run_batch(spark, config: Config, questions: str, answers: str, answer: Callable, provenance: bool = False) -> Path:
    """Answer a file of questions: ``answer`` maps a frame of (index, question) to one with first, second, fallback and error.

    first and second are a model's replies, null where it failed; the file is small, as
    one person's batch is, and is collected to be written in order.
    """
    from pyspark.sql import functions as F

    from .operators import answers as A
    from .operators.service import BLANK
    from .sources.jsonl import read_questions

    source = input_path(questions, config.root)
    asked = read_questions(spark, str(source))
    made = A.batch(answer(asked), F.col("first"), F.col("second"), F.col("fallback"), BLANK)
    local = (Path.cwd() / INPUTS).resolve()
    out = output_path(answers, config.root, prefer_cwd=source.is_relative_to(local) and not source.is_relative_to((config.root / INPUTS).resolve()))
    blank = F.trim("question") == ""
    rows = made.select("index", "question", "model", "mode", F.when(blank, "missing question").when(F.col("mode") == "llm", "").otherwise(F.col("error")).alias("error"))
    write_answers((r.asDict() for r in rows.collect()), out, provenance)
    return out


def main(arguments: list[str] | None = None) -> int:
    """validate, documents or doctor for a workspace; prints JSON and returns the exit code."""
    import argparse

    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="tidewrack")
    parser.add_argument("command", choices=["validate", "doctor"])
    parser.add_argument("--workspace")
    told = parser.parse_args(arguments)
    try:
        path = str(discover(told.workspace))
    except ConfigError as e:
        print(json.dumps(rollup([Check("workspace", (str(e),), 2)]), ensure_ascii=False))
        return 2
    said = rollup([validate(path)[1]]) if told.command == "validate" else doctor(SparkSession.builder.getOrCreate(), path)
    print(json.dumps(said, ensure_ascii=False))
    return said["exit_code"]


if __name__ == "__main__":
    sys.exit(main())

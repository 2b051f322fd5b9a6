"""Presets: YAML or dict steps run once, or once for each input, over registered calls."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

_CALLS: dict[str, Callable] = {}
_TOKEN = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")


def register(name: str, call: Callable) -> None:
    """Offer a call to presets. Only registered calls run; nothing is imported by name."""
    _CALLS[name] = call


def resolve(name: str) -> Callable:
    """The call of a name; ``theme:call`` and ``theme.call`` mean the same."""
    name = name.replace(":", ".")
    if name not in _CALLS:
        import sheaf.plans.calls  # noqa: F401  registers the calls of this package

    if name not in _CALLS:
        raise KeyError(f"{name!r} is not registered; there are {sorted(_CALLS)}")
    return _CALLS[name]


def typed(text: str) -> Any:
    """true/false, null/none, a float with a dot, an int, else the text."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none"):
        return None
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text


def parse_bool(text: str | bool) -> bool:
    if isinstance(text, bool):
        return text
    if text.strip().lower() in ("1", "true", "yes", "on"):
        return True
    if text.strip().lower() in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"not a yes or no: {text!r}")


def merged(preset: dict | None, file: dict | None, given: list[str] | dict | None) -> dict:
    """Variables of the preset, then of a file, then given ones as ``k=v``."""
    out = {**(preset or {}), **(file or {})}
    pairs = given.items() if isinstance(given, dict) else ((k, typed(v)) for k, v in (x.split("=", 1) for x in given or []))
    return {**out, **dict(pairs)}


def _dig(value: Any, path: list[str]) -> Any:
    for p in path:
        value = value[p] if isinstance(value, dict) else getattr(value, p)
    return value


_UNKNOWN = object()


def _lookup(name: str, ctx: dict) -> Any:
    try:
        if name == "input":
            return ctx["input"]
        if name == "cwd":
            return str(Path.cwd())
        if name.startswith("var:"):
            return ctx["vars"][name[4:]]
        if name.startswith("global."):
            return _dig(ctx["globals"], name.split(".")[1:])
        if name.startswith("pick:"):
            return _dig(ctx["artifacts"], name[5:].split("."))
        if name in ctx.get("artifacts", {}):
            return ctx["artifacts"][name]
        return ctx["globals"][name]
    except (KeyError, AttributeError, TypeError):
        if name.startswith(("var:", "global.", "pick:")):
            raise KeyError(f"{{{{{name}}}}} has no value") from None
        return _UNKNOWN


def render(value: Any, ctx: dict) -> Any:
    """Fill in templates. A string that is one template keeps the value's type; a bare name
    without a value stays as it is."""
    if isinstance(value, dict):
        return {k: render(v, ctx) for k, v in value.items()}
    if isinstance(value, list):
        return [render(v, ctx) for v in value]
    if not isinstance(value, str):
        return value
    whole = _TOKEN.fullmatch(value.strip())
    if whole:
        found = _lookup(whole[1], ctx)
        return value if found is _UNKNOWN else found

    def put(m: re.Match) -> str:
        found = _lookup(m[1], ctx)
        return m[0] if found is _UNKNOWN else str(found)

    return _TOKEN.sub(put, value)


def json_safe(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return json_safe(dataclasses.asdict(value))
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def _ready(step: dict, args: dict) -> None:
    empty = [k for k in step.get("require", []) if args.get(k) in (None, "", [])]
    if empty:
        raise ValueError(f"required but empty: {empty}")


def run_preset(preset: dict, *, inputs: list[str] | None = None, variables: dict | None = None, manifest_path: str | None = None, workers: int = 4) -> dict:
    """Run the steps in order and return the manifest, which is saved after each step.

    A failing item drops out of later steps; a failing global step ends the run.
    """
    manifest: dict = {"vars": {**preset.get("vars", {}), **(variables or {})}, "items": [{"input": i, "artifacts": {}, "status": "ok", "errors": []} for i in inputs or []], "globals": {}, "errors": []}

    def save() -> None:
        if manifest_path:
            Path(manifest_path).write_text(json.dumps(json_safe(manifest), indent=1), encoding="utf-8")

    def one(step: dict, item: dict) -> None:
        try:
            ctx = {"input": item["input"], "vars": manifest["vars"], "globals": manifest["globals"], "artifacts": item["artifacts"]}
            args = render(step.get("with", {}), ctx)
            _ready(step, args)
            out = resolve(step["call"])(**args)
            if step.get("save_as"):
                item["artifacts"][step["save_as"]] = out
        except Exception as e:
            item["status"] = "error"
            item["errors"].append(f"{step['call']}: {e}")

    for step in preset.get("steps", []):
        if step.get("scope", "item").lower() == "item":
            with ThreadPoolExecutor(step.get("workers", workers)) as pool:
                list(pool.map(lambda i, s=step: one(s, i), [i for i in manifest["items"] if i["status"] == "ok"]))
            save()
            continue
        try:
            ctx = {"input": None, "vars": {**manifest["vars"], "run_manifest": manifest_path}, "globals": manifest["globals"], "artifacts": {}}
            args = render(step.get("with", {}), ctx)
            _ready(step, args)
            out = resolve(step["call"])(**args)
            if step.get("save_as"):
                manifest["globals"][step["save_as"]] = out
        except Exception as e:
            manifest["errors"].append(f"{step['call']}: {e}")
            save()
            break
        save()
    return manifest


PRESETS = Path(__file__).with_name("presets")


def load_preset(path: str) -> dict:
    """A preset by the path of a YAML file, if a YAML reader is installed, or of a JSON file; or
    by its name among those shipped and those in ``./pipelines``."""
    if not path.endswith((".json", ".yaml", ".yml")):
        return describe_preset(path)
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def preset_paths() -> list[Path]:
    folders = [PRESETS, Path("pipelines")]
    return [p for f in folders if f.is_dir() for p in sorted(f.rglob("*")) if p.suffix in (".json", ".yaml", ".yml")]


def list_presets() -> list[dict]:
    """``id``, ``title``, ``tags`` and ``path`` of the presets there are; those that cannot be
    read are named by their files."""
    found = []
    for p in preset_paths():
        try:
            meta = load_preset(str(p)).get("meta", {})
        except (ImportError, ValueError):
            meta = {}
        found.append({"id": meta.get("id", p.stem), "title": meta.get("title", p.stem.replace("_", " ")), "tags": meta.get("tags", []), "path": str(p)})
    return found


def describe_preset(name: str) -> dict:
    """The preset of an id or of a file's name."""
    for p in list_presets():
        if name in (p["id"], Path(p["path"]).stem):
            return load_preset(p["path"])
    raise KeyError(f"no preset {name!r}; there are {[p['id'] for p in list_presets()]}")


def read_variables(path: str | None) -> dict:
    """Variables of a JSON or YAML file; none without a path."""
    return load_preset(path) if path else {}

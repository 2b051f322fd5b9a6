"""Command line: ``python -m sheaf.cli COMMAND ...``. A command for each registered call, with
an option for each of its parameters, and ``run``, ``presets`` and ``describe`` for presets."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from collections.abc import Callable

#: Commands and the calls they make.
COMMANDS = {
    "gather": "helpers.text_gather", "texts": "helpers.txt_gather", "features": "helpers.feature_gather", "find": "helpers.find_files",
    "lexical": "text.analyze_lexical_richness", "readability": "text.analyze_readability", "dictionaries": "text.analyze_with_dictionaries",
    "archetypes": "text.analyze_with_archetypes", "embeddings": "text.analyze_with_sentence_embeddings", "subtitles": "text.convert_subtitles",
    "wav": "audio.convert_to_wav", "streams": "audio.split_streams_to_wav", "diarize": "audio.diarize", "speakers": "audio.split_wav_by_speaker",
    "acoustics": "audio.analyze_vocal_acoustics", "sound-embeddings": "audio.extract_sound_embeddings",
}


def parameters(call: Callable) -> dict[str, inspect.Parameter]:
    """A call's parameters; those of the texts it reads in place of ``**texts``."""
    from sheaf.plans import calls

    found = dict(inspect.signature(call).parameters)
    if found.pop("texts", None) is not None:
        given = inspect.signature(calls._measured).parameters
        found |= {k: p for k, p in given.items() if p.kind is p.KEYWORD_ONLY}
    return found


def _add(command: argparse.ArgumentParser, name: str, p: inspect.Parameter) -> None:
    from sheaf.plans.runner import parse_bool

    kind, needed = str(p.annotation), p.default is p.empty
    if needed and p.kind is p.POSITIONAL_OR_KEYWORD:
        command.add_argument(name)
        return
    how = {"type": int if kind.startswith("int") else float if kind.startswith("float") else str}
    if kind.startswith("list"):
        how = {"nargs": "+" if needed else "*"}
    elif kind.startswith("bool"):
        how = {"type": parse_bool, "nargs": "?", "const": True}
    command.add_argument(f"--{name.replace('_', '-')}", dest=name, required=needed, default=argparse.SUPPRESS, help=None if needed else f"default: {p.default}", **how)


def parser() -> argparse.ArgumentParser:
    from sheaf.plans.runner import resolve

    p = argparse.ArgumentParser(prog="sheaf")
    sub = p.add_subparsers(dest="command", required=True)
    for command, name in COMMANDS.items():
        call = resolve(f"sheaf.{name}")
        c = sub.add_parser(command, help=(call.__doc__ or "").split("\n")[0])
        for k, parameter in parameters(call).items():
            _add(c, k, parameter)
    c = sub.add_parser("run", help="run a preset, by its name or its file")
    c.add_argument("preset")
    c.add_argument("--root")
    c.add_argument("--type", default="any")
    c.add_argument("--var", action="append", default=[])
    c.add_argument("--vars-file")
    c.add_argument("--workers", type=int, default=4)
    c.add_argument("--manifest")
    sub.add_parser("presets", help="list the presets")
    c = sub.add_parser("describe", help="show a preset")
    c.add_argument("preset")
    return p


def main(args: list[str] | None = None) -> int:
    from sheaf.plans import runner
    from sheaf.sources import files

    given = vars(parser().parse_args(args))
    command = given.pop("command")
    if command == "presets":
        for p in runner.list_presets():
            print(f"{p['id']}\t{p['title']}\t{', '.join(p['tags'])}\t{p['path']}")
        return 0
    if command == "describe":
        try:
            print(json.dumps(runner.describe_preset(given["preset"]).get("meta", {}), indent=1))
        except KeyError as e:
            print(e.args[0], file=sys.stderr)
            return 1
        return 0
    if command == "run":
        preset = runner.load_preset(given["preset"])
        inputs = files.discover_inputs(given["root"], given["type"]) if given["root"] else []
        variables = runner.merged(None, runner.read_variables(given["vars_file"]), given["var"])
        m = runner.run_preset(preset, inputs=inputs, variables=variables, manifest_path=given["manifest"], workers=given["workers"])
        print(json.dumps(runner.json_safe(m)))
        return 1 if m["errors"] else 0
    out = runner.resolve(f"sheaf.{COMMANDS[command]}")(**given)
    print("\n".join(map(str, out)) if isinstance(out, list) else json.dumps(out) if isinstance(out, dict) else out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

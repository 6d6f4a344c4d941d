"""Command: ``python -m tokenfjord [infile] [outfile] [options]``."""

from __future__ import annotations

import argparse
import contextlib
import sys

from . import __version__
from .operators.engine import tokenize
from .operators.frames import output_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tokenfjord", description="Tokenizes Icelandic text.")
    p.add_argument("infile", nargs="?", default="-", help="UTF-8 text file; - for standard input")
    p.add_argument("outfile", nargs="?", default="-", help="UTF-8 output file; - for standard output")
    form = p.add_mutually_exclusive_group()
    form.add_argument("--csv", action="store_true", help="a line of CSV per token")
    form.add_argument("--json", action="store_true", help="a line of JSON per token")
    for short, name, what in (
        ("s", "one_sent_per_line", "each input line is a sentence"),
        ("m", "convert_measurements", "write degrees as in 25 °C"),
        ("p", "coalesce_percent", "join numbers and words for percent"),
        ("n", "normalize", "print normal forms of punctuation"),
        ("o", "original", "print the original text of tokens"),
        ("g", "keep_composite_glyphs", "keep combining marks"),
        ("e", "replace_html_escapes", "resolve HTML escapes"),
        ("c", "convert_numbers", "write English numbers the Icelandic way"),
    ):
        p.add_argument(f"-{short}", f"--{name}", action="store_true", help=what)
    p.add_argument("--abbreviations", help="path of an abbreviation dictionary")
    p.add_argument("-v", "--version", action="version", version=f"%(prog)s {__version__}")
    return p


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    form = "csv" if args.pop("csv") else "json" if args.pop("json") else "text"
    options = args | {"replace_composite_glyphs": not args["keep_composite_glyphs"]}
    with contextlib.ExitStack() as stack:
        source = sys.stdin if args["infile"] == "-" else stack.enter_context(open(args["infile"], encoding="utf-8"))
        sink = sys.stdout if args["outfile"] == "-" else stack.enter_context(open(args["outfile"], "w", encoding="utf-8"))
        for line in output_lines(tokenize(source, **options), form, args["original"], args["normalize"]):
            print(line, file=sink)


if __name__ == "__main__":
    main()

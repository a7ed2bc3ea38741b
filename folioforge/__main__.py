"""python -m folioforge estimate | translate | annotate BOOK"""

from __future__ import annotations

import argparse
import os
import sys

from folioforge.config import Config, ReaderProfile, unknown_presets
from folioforge.plans import books, translate
from folioforge.session import local_session


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="folioforge")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("estimate", "translate", "annotate"):
        v = verbs.add_parser(verb)
        v.add_argument("book")
        v.add_argument("--model", default="gpt-5.4-mini" if verb == "estimate" else "mock")
        v.add_argument("--level", default="sentence")
        v.add_argument("--notes", action="store_true", help="with notes in the margin")
        v.add_argument("--note-density", default=None)
        if verb != "estimate":
            v.add_argument("--to", default="English", help="target language")
            v.add_argument("--out")
            v.add_argument("--job", help="folder of the resume cache")
            v.add_argument("--mode", default="replace")
            v.add_argument("--provider", default="mock")
            v.add_argument("--base-url", default="")
            v.add_argument("--prompt")
            v.add_argument("--json", action="store_true", help="events as JSON lines")
            for name in ("profile", "presets", "style", "lang", "voice"):
                v.add_argument(f"--note-{name}")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = local_session()
    if a.verb == "estimate":
        print(books.event("estimate", **books.estimate_book(spark, a.book, a.model, a.level, (a.note_density or "medium") if a.notes else None)))
        return 0
    anno = None
    if a.notes or a.verb == "annotate":
        profile = ReaderProfile.load(a.note_profile) if a.note_profile else ReaderProfile()
        presets = a.note_presets.split(",") if a.note_presets else None
        for p in unknown_presets(presets or []):
            print(f"unknown preset ignored: {p}", file=sys.stderr)
        anno = profile.annotations(density=a.note_density, presets=presets, style=a.note_style, lang=a.note_lang, voice=a.note_voice)
    config = Config(a.to, a.level, a.prompt, a.mode, a.provider, a.model, annotations=anno)
    out = a.out or books.default_output(a.book, a.to if a.verb == "translate" else "notes", spark)
    on = (lambda phase, **values: print(books.event(phase, **values), flush=True)) if a.json else translate.silent
    found = books.decided(spark, a.book, config, a.job or f"{out}.job", a.verb == "annotate", a.base_url, os.environ.get("FOLIOFORGE_API_KEY", ""), True, on)
    books.write_book(spark, a.book, found, out, config)
    result = books.summary(found)
    print(books.event("done", out=out, **result) if a.json else f"{out}: {result}")
    return 0 if a.json or not result["failed"] else 1


if __name__ == "__main__":
    sys.exit(main())

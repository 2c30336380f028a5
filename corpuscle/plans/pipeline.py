"""The whole run, from a dump to a trained model, and a command for each step."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from ..functions.text import get_default_tokenizer, get_sentence_detector, get_tokenizer
from ..operators.dictionary import Dictionary
from ..operators.graph import LinkGraph
from ..operators.mentions import MentionDB
from ..operators.training import train
from ..operators.vectors import Embedding
from ..params import DictionaryParams, MentionParams, TrainParams
from ..sources import artefacts
from ..sources.dump import PageStore, dump_language, read_dump


def build_page_store(spark: SparkSession, dump_file: str, out: str) -> PageStore:
    lang = dump_language(spark, dump_file)
    return PageStore.build(read_dump(spark, dump_file, lang), out, dump_file, lang)


def build_dictionary(spark: SparkSession, store: str, out: str, params: DictionaryParams = DictionaryParams(), tokenizer: str | None = None) -> Dictionary:
    s = PageStore.open(spark, store)
    tok = get_tokenizer(tokenizer, s.language) if tokenizer else get_default_tokenizer(s.language)
    d = Dictionary.build(s.paragraphs, s.links(), s.redirects, s.disambiguations(), s.language, params, tok)
    artefacts.save_dictionary(d, out)
    return artefacts.load_dictionary(spark, out)


def build_link_graph(spark: SparkSession, store: str, dictionary: str, out: str) -> LinkGraph:
    d = artefacts.load_dictionary(spark, dictionary)
    artefacts.save_graph(LinkGraph.build(PageStore.open(spark, store).links(), d), out)
    return artefacts.load_graph(spark, out, d)


def build_mention_db(spark: SparkSession, store: str, dictionary: str, out: str, params: MentionParams = MentionParams(), tokenizer: str | None = None) -> MentionDB:
    s, d = PageStore.open(spark, store), artefacts.load_dictionary(spark, dictionary)
    tok = get_tokenizer(tokenizer, s.language) if tokenizer else get_default_tokenizer(s.language)
    artefacts.save_mentions(MentionDB.build(s.paragraphs, s.links(), d, params, tokenizer=tok), out)
    return artefacts.load_mentions(spark, out, d)


def train_embedding(spark: SparkSession, store: str, dictionary: str, out: str, link_graph: str | None = None, mention_db: str | None = None, params: TrainParams = TrainParams(), sentence_detector: str | None = None) -> Embedding:
    s, d = PageStore.open(spark, store), artefacts.load_dictionary(spark, dictionary)
    g = artefacts.load_graph(spark, link_graph, d) if link_graph else None
    m = artefacts.load_mentions(spark, mention_db, d) if mention_db else None
    cut = get_sentence_detector(sentence_detector, s.language)(s.paragraphs, ["title", "para_no"]) if sentence_detector else None
    model = train(s.paragraphs, s.links(), d, g, m, params, sentences=cut)
    artefacts.save_model(model, out)
    return artefacts.load_model(spark, out)


def save_text(spark: SparkSession, model: str, out: str, out_format: str = "default") -> None:
    artefacts.save_text(artefacts.load_model(spark, model).items, out, out_format)


def run_all(spark: SparkSession, dump_file: str, out: str, dictionary: DictionaryParams = DictionaryParams(), mention: MentionParams = MentionParams(), training: TrainParams = TrainParams(), link_graph: bool = True, disambiguate: bool = True) -> Embedding:
    """All five steps; what lies between goes to folders named after the result."""
    store, dic, graph, names = f"{out}_db", f"{out}_dic", f"{out}_lg", f"{out}_mention"
    build_page_store(spark, dump_file, store)
    build_dictionary(spark, store, dic, dictionary)
    if link_graph:
        build_link_graph(spark, store, dic, graph)
    if disambiguate:
        build_mention_db(spark, store, dic, names, mention)
    return train_embedding(spark, store, dic, out, graph if link_graph else None, names if disambiguate else None, training)


def _options(parser: argparse.ArgumentParser, kind: type) -> None:
    for f in fields(kind):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(flag, type=type(f.default), default=f.default)


def _params(kind: type, args: argparse.Namespace):
    return kind(**{f.name: getattr(args, f.name) for f in fields(kind)})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuscle")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, kinds: tuple[type, ...] = ()) -> argparse.ArgumentParser:
        c = sub.add_parser(name, conflict_handler="resolve")
        for x in positional:
            c.add_argument(x)
        for k in kinds:
            _options(c, k)
        return c

    command("build-page-store", "dump_file", "out")
    command("build-dictionary", "store", "out", kinds=(DictionaryParams,)).add_argument("--tokenizer")
    command("build-link-graph", "store", "dictionary", "out")
    command("build-mention-db", "store", "dictionary", "out", kinds=(MentionParams,)).add_argument("--tokenizer")
    t = command("train-embedding", "store", "dictionary", "out", kinds=(TrainParams,))
    for x in ("--link-graph", "--mention-db", "--sentence-detector"):
        t.add_argument(x)
    command("save-text", "model", "out").add_argument("--out-format", choices=("default", "word2vec", "glove"), default="default")
    a = command("train", "dump_file", "out", kinds=(DictionaryParams, MentionParams, TrainParams))
    a.add_argument("--link-graph", action=argparse.BooleanOptionalAction, default=True)
    a.add_argument("--disambiguate", action=argparse.BooleanOptionalAction, default=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpuscle").getOrCreate()
    if a.command == "build-page-store":
        build_page_store(spark, a.dump_file, a.out)
    elif a.command == "build-dictionary":
        build_dictionary(spark, a.store, a.out, _params(DictionaryParams, a), a.tokenizer)
    elif a.command == "build-link-graph":
        build_link_graph(spark, a.store, a.dictionary, a.out)
    elif a.command == "build-mention-db":
        build_mention_db(spark, a.store, a.dictionary, a.out, _params(MentionParams, a), a.tokenizer)
    elif a.command == "train-embedding":
        train_embedding(spark, a.store, a.dictionary, a.out, a.link_graph, a.mention_db, _params(TrainParams, a), a.sentence_detector)
    elif a.command == "save-text":
        save_text(spark, a.model, a.out, a.out_format)
    else:
        run_all(spark, a.dump_file, a.out, _params(DictionaryParams, a), _params(MentionParams, a), _params(TrainParams, a), a.link_graph, a.disambiguate)

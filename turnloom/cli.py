"""Command line: python -m turnloom.cli COMMAND ...

build-dataset  CSV of pairs -> split Parquet and a data report
run-arm        one arm over the test split -> scores as JSON; the arm `model` generates with --generator or --loader
compare        all arms' scores -> tables of differences
contamination  memorisation probe over a split
check-leak     files -> exit status 1 if any must not be published
show           one note of a split and its scores under an arm, or under each of several side by side
pack           a split's training texts -> token sequences of one size as Parquet
transcribe     wav files -> stretches of speech as Parquet, and their texts by --transcriber

--generator, --loader, --transcriber and --encoder name a function of an importable module, MODULE:FUNCTION: one over Arrow batches
(note_id, clinical_note) -> (note_id, generated, gen_tokens), one that loads a model (operators/model.py), one from a
waveform to its text, one from a text to its token vectors; --encoder learned learns word vectors from the training split.
--tokenizer names a file of ranked byte-pair tokens; texts of arms that do not count their tokens are counted with it.
--config FILE of a command: a YAML mapping of its options; what the command line gives goes before it.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnloom.functions import leak, text
from turnloom.operators import arms, compare, contamination, continuation, dataset, embedscore, model, order, packing, report, wordvectors
from turnloom.operators.retrieval import Retriever
from turnloom.session import session
from turnloom.sources import audio, io


def build_dataset(spark: SparkSession, a) -> int:
    raw = io.read_pairs_csv(spark, a.csv).withColumn("__ord", F.monotonically_increasing_id())
    records = dataset.records(raw, "__ord").cache()
    splits = records.join(dataset.split(records.select("note_id"), seed=a.seed), "note_id").cache()
    io.write_splits(splits, a.out)
    io.write_text(report.data_report(records, splits, raw.count()), a.report)
    return 0


def _pairs(spark: SparkSession, a):
    return order.first_n(io.read_split(spark, a.data, a.split), "note_id", a.n, a.seed).select("note_id", "clinical_note", "conversation")


def _retrieved(spark: SparkSession, a, pairs):
    """note_id and the dialogue of the nearest training note."""
    train = io.read_split(spark, a.data, "train")
    top = Retriever().fit(train.select("note_id", F.col("clinical_note").alias("text"))).top(pairs.select("note_id", F.col("clinical_note").alias("text")))
    found = top.select(F.col("query_id").alias("note_id"), F.col("note_id").alias("__from"))
    return found.join(train.select(F.col("note_id").alias("__from"), F.col("conversation").alias("generated")), "__from").select("note_id", "generated")


def _made(spark: SparkSession, a, arm: str, pairs):
    if arm == "model":
        if bool(a.generator) == bool(a.loader):
            raise ValueError("the arm model goes with --generator or --loader")
        if a.generator:
            return arms.mapped(model.named(a.generator))(pairs)
        spec = model.Spec(a.loader, a.model_name, a.adapter, a.max_seq_len, seed=a.seed)
        return model.generator(spec, a.max_new_tokens, a.sampled, a.temperature)(pairs)
    return _retrieved(spark, a, pairs) if arm == "retrieval" else arms.ARMS[arm](pairs)


def _encoder(spark: SparkSession, a):
    if a.encoder == "learned":
        train = io.read_split(spark, a.data, "train")
        return wordvectors.fit(train.select(F.col("clinical_note").alias("text")).union(train.select("conversation")), seed=a.seed).encoder(spark)
    return {"hashed": embedscore.hashed, "none": None}[a.encoder] if a.encoder in ("hashed", "none") else model.named(a.encoder)


def run_arm(spark: SparkSession, a) -> int:
    """The arm's texts are generated and scored by one job, which also counts them; the rest reads what it wrote."""
    if a.arm != "model" and (a.generator or a.loader):
        raise ValueError("--generator and --loader go with the arm model")
    name = a.name or a.arm
    pairs, encode = _pairs(spark, a), _encoder(spark, a)
    made = _made(spark, a, a.arm, pairs)
    if "gen_tokens" not in made.columns and a.tokenizer:
        made = made.withColumn("gen_tokens", packing.Tokenizer(spark, a.tokenizer).count(F.col("generated")))
    speed = arms.Speed(made, "gen_tokens" if "gen_tokens" in made.columns else None)
    scores = arms.scored(pairs.join(speed.made.select("note_id", "generated", *(["gen_tokens"] if "gen_tokens" in made.columns else [])), "note_id"), encode=encode)
    io.write_arms(scores.withColumn("arm", F.lit(name)), f"{a.out}/{name}", {"decoding": F.struct(F.lit(a.sampled).alias("do_sample")), "model_name": F.lit(a.generator or (a.loader and (a.adapter or a.model_name))).cast("string")})
    took = speed.result()
    scores = io.read_arms(spark, f"{a.out}/{name}/*/*.txt", [name])
    metrics = [m for m in io.SCORES if scores.where(F.col(m).isNotNull()).limit(1).count()]
    valid = arms.valid_rate(scores).first().turn_format_valid_rate
    results = {"arm": name, "split": a.split, "seed": a.seed, "encoder": a.encoder, "adapter": a.adapter, "n_records": took.pop("n_records"), "aggregate": io.as_records(arms.aggregate(scores, [name], metrics))}
    io.write_json(results | {"turn_format_valid_rate": valid, "throughput": took}, f"{a.out}/{name}/summary.json")
    return 0


def pack(spark: SparkSession, a) -> int:
    rows = io.read_split(spark, a.data, a.split)
    said = text.chat_text(text.chat_messages(F.col("clinical_note"), F.col("conversation")))
    ids = rows.select("note_id", packing.Tokenizer.of_chat(spark, a.tokenizer).ids(said).alias("ids"))
    placed = packing.pack(ids.select("note_id", F.size("ids").alias("n_tokens")), a.max_seq_len, a.seed)
    packing.sequences(placed, ids, a.max_seq_len).write.mode("overwrite").parquet(a.out)
    whole = spark.read.parquet(a.out).agg(F.count("*").alias("bins"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    print(f"{whole.tokens} tokens in {whole.bins} sequences of {a.max_seq_len}" + (f", {100 * whole.tokens / whole.bins / a.max_seq_len:.1f}% full" if whole.bins else ""))
    return 0


def compare_arms(spark: SparkSession, a) -> int:
    scores = io.read_arms(spark, f"{a.out}/*/*/*.txt", a.arms).cache()
    names = sorted(r[0] for r in scores.select("arm").distinct().collect())
    if sampling := compare.stochastic(scores):
        print("warning: decoding samples in " + ", ".join(sampling), file=sys.stderr)
    there = [m for m in io.SCORES if scores.where(F.col(m).isNotNull()).limit(1).count()]
    means, valid, deltas = arms.aggregate(scores, names, there), arms.valid_rate(scores), compare.compare(scores, names)
    print(compare.markdown(means, valid, deltas))
    io.write_json({"arms": names, "aggregate": io.as_records(means), "turn_format": io.as_records(valid), "deltas": io.as_records(deltas)}, f"{a.out}/comparison.json")
    scores.unpersist()
    return 0


def probe(spark: SparkSession, a) -> int:
    rows = io.read_split(spark, a.data, a.split).select("note_id", "conversation")
    by_heart = None
    if a.memory:
        held = io.read_split(spark, a.data, a.memory).select("note_id", F.col("conversation").alias("text"))
        by_heart = contamination.from_corpus(held, a.max_new_tokens)
    deltas = contamination.delta(contamination.probe(rows, n=a.n, seed=a.seed, continue_all=by_heart)).cache()
    verdict = contamination.verdict(deltas)
    print(contamination.report(deltas, verdict))
    if a.json:
        io.write_json({"split": a.split, "n": a.n, "seed": a.seed, "metrics": io.as_records(deltas)} | verdict.first().asDict(), a.json)
    deltas.unpersist()
    return 0


def check_leak(spark: SparkSession, a) -> int:
    """Reasons are told by relative path; paths that are no files are passed over."""
    files = [f for f in a.files if os.path.isfile(f)]
    if not files:
        return 0
    paths = ["file:" + os.path.abspath(f) for f in files]
    rows = spark.createDataFrame(list(zip(files, paths)), "rel string, path string")
    found = rows.join(io.read_texts(spark, *paths), "path").select("rel", leak.reasons(F.col("rel"), F.col("text")).alias("why")).where(F.size("why") > 0)
    bad = found.orderBy("rel").collect()
    for r in bad:
        print(f"{r.rel}: {', '.join(r.why)}")
    return int(bool(bad))


def show(spark: SparkSession, a) -> int:
    notes = io.read_split(spark, a.data, a.split)
    if a.which == "random":
        one = order.first_n(notes, "note_id", 1, a.seed)
    else:
        one = io.note_at(notes, a.which if a.which.startswith("note-") else int(a.which))
    pair = one.select("note_id", "clinical_note", "conversation")
    print(pair.select(text.shown(F.col("clinical_note"))).first()[0])
    found = {arm: arms.scored(pair.join(_made(spark, a, arm, pair).select("note_id", "generated"), "note_id")) for arm in [a.arm, *(a.compare or [])]}
    print(report.one_record(found[a.arm]) if len(found) == 1 else report.side_by_side(found))
    return 0


def transcribe(spark: SparkSession, a) -> int:
    """Stretches of speech of wav files to --out, and with a transcriber their texts."""
    found = audio.stretches(io.read_audio(spark, *["file:" + os.path.abspath(f) for f in a.files]))
    found.write.mode("overwrite").parquet(a.out)
    if a.transcriber:
        for r in audio.transcribed(spark.read.parquet(a.out), model.named(a.transcriber)).orderBy("path").toLocalIterator():
            print(f"{os.path.basename(r.path)}: {r.text}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(required=True)

    def command(name: str, f, *options: tuple[str, dict]):
        p = sub.add_parser(name)
        for flag, kw in options:
            p.add_argument(flag, **kw)
        p.add_argument("--config")
        p.set_defaults(run=f, parser=p)

    seed, data = ("--seed", {"type": int, "default": 42}), ("--data", {"required": True})
    out = ("--out", {"required": True})
    split = lambda x: ("--split", {"default": x})
    n = lambda x: ("-n", {"type": int, "default": x})
    command("build-dataset", build_dataset, ("csv", {}), out, ("--report", {"required": True}), seed)
    number = lambda flag, x: (flag, {"type": type(x), "default": x})
    length, tokenizer = number("--max-seq-len", packing.CAPACITY), ("--tokenizer", {})
    loaded = ("--generator", {}), ("--loader", {}), ("--model-name", {"default": ""}), ("--adapter", {}), ("--sampled", {"action": "store_true"})
    loaded += length, number("--max-new-tokens", model.MAX_NEW_TOKENS), number("--temperature", model.TEMPERATURE)
    command("run-arm", run_arm, ("arm", {"choices": sorted([*arms.ARMS, "model"])}), data, out, split("test"), n(200), seed, ("--encoder", {"default": "hashed"}), ("--name", {}), tokenizer, *loaded)
    command("pack", pack, data, out, split("train"), ("--tokenizer", {"required": True}), length, seed)
    command("compare", compare_arms, out, ("--arms", {"nargs": "*"}))
    command("contamination", probe, data, split("test"), n(100), seed, ("--json", {}), ("--memory", {}), number("--max-new-tokens", continuation.NEW_WORDS))
    command("check-leak", check_leak, ("files", {"nargs": "*"}))
    shown = ["half", "model", "retrieval", "self"]
    command("transcribe", transcribe, ("files", {"nargs": "+"}), out, ("--transcriber", {}))
    command("show", show, ("which", {}), data, split("test"), ("--arm", {"choices": shown, "default": "half"}), ("--compare", {"nargs": "+", "choices": shown}), seed, *loaded)
    a = top.parse_args(argv)
    if a.config:
        known = {x.dest for x in a.parser._actions} - {"help", "config"}
        given = {k.replace("-", "_"): v for k, v in io.read_config(a.config).items()}
        if odd := sorted(set(given) - known):
            raise ValueError(f"{a.config}: unknown options {odd}")
        a.parser.set_defaults(**given)
        a = top.parse_args(argv)
    return a.run(spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())

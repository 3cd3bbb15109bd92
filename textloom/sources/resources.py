"""Tokenizer files of a local folder: vocabularies, merges, specials and settings in their several formats."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.splitting import PATTERN
from textloom.operators.tokenizer import TokenizerSpec, load, read_merges

#: Other names under which a file of a tokenizer may be found.
ALIASES = {"vocab.json": ("encoder.json",), "merges.txt": ("vocab.bpe",), "specials.txt": ("specials.json",)}


@dataclass
class Settings:
    """What the configuration files of a tokenizer say, with defaults where they say nothing."""

    model_type: str | None = None
    tokenizer_class: str | None = None
    vocab_size: int | None = None
    bos: str | None = None
    eos: str | None = None
    pad: str | None = None
    add_bos: bool = False
    add_eos: bool = False
    newline_mode: str | None = None
    ignore_merges: bool = False
    added: dict[str, int] = field(default_factory=dict)


def find(folder: str, name: str) -> str | None:
    """Path of a file of a folder, under its name or an alias."""
    for n in (name, *ALIASES.get(name, ())):
        if os.path.isfile(p := os.path.join(folder, n)):
            return p
    return None


def _json(folder: str, name: str) -> dict | list | None:
    p = find(folder, name)
    if p is None:
        return None
    with open(p, encoding="utf-8") as f:
        return json.load(f)


def _content(value) -> str | None:
    """A token given as a string or as an object with its content."""
    return value.get("content") if isinstance(value, dict) else value


def read_vocab(folder: str) -> dict[str, int]:
    """Pieces and ids: vocab.json, else tokenizer.json; tokens added in tokenizer_config.json join them."""
    vocab = _json(folder, "vocab.json")
    if vocab is None:
        whole = _json(folder, "tokenizer.json")
        if whole is None:
            raise FileNotFoundError(f"no vocabulary in {folder}")
        model = whole["model"]["vocab"]
        vocab = dict(model) if isinstance(model, dict) else {p: k for k, (p, _) in enumerate(model)}
        for t in whole.get("added_tokens") or []:
            vocab.setdefault(t["content"], t["id"])
    return {**vocab, **settings(folder).added}


def read_ranked_merges(folder: str, skip_header: bool | None = None) -> list[tuple[str, str]]:
    """Merges in order of rank: merges.txt, else merges.json, else tokenizer.json."""
    if (p := find(folder, "merges.txt")) is not None:
        return read_merges(p, skip_header)
    rows = _json(folder, "merges.json")
    if rows is None:
        rows = ((_json(folder, "tokenizer.json") or {}).get("model") or {}).get("merges") or []
    return [tuple(m.split(" ", 1)) if isinstance(m, str) else (m["left"], m["right"]) if isinstance(m, dict) else (m[0], m[1]) for m in rows]


def settings(folder: str) -> Settings:
    """From config.json, tokenizer_config.json, special_tokens_map.json and generation settings; later files win."""
    out = Settings()
    config = _json(folder, "config.json") or {}
    out.model_type, out.vocab_size, out.newline_mode = config.get("model_type"), config.get("vocab_size"), config.get("newlinemode")
    tokenizer = _json(folder, "tokenizer_config.json") or {}
    out.tokenizer_class = tokenizer.get("tokenizer_class")
    out.add_bos, out.add_eos = bool(tokenizer.get("add_bos_token", False)), bool(tokenizer.get("add_eos_token", False))
    out.newline_mode = tokenizer.get("newlinemode", out.newline_mode)
    out.added = {_content(v): int(k) for k, v in (tokenizer.get("added_tokens_decoder") or {}).items()}
    for source in (config, tokenizer, _json(folder, "special_tokens_map.json") or {}):
        for name in ("bos", "eos", "pad"):
            if isinstance(v := _content(source.get(f"{name}_token")), str):
                setattr(out, name, v)
    whole = _json(folder, "tokenizer.json") or {}
    out.ignore_merges = bool((whole.get("model") or {}).get("ignore_merges", False))
    return out


def special_tokens(folder: str) -> list[str]:
    """Special literals: specials.txt (one a line) or specials.json, and those of special_tokens_map.json, given either way."""
    out: list[str] = []
    if (p := find(folder, "specials.txt")) is not None:
        with open(p, encoding="utf-8") as f:
            text = f.read()
        if p.endswith(".json"):
            held = json.loads(text)
            out += list(held.values()) if isinstance(held, dict) else list(held)
        else:
            out += [x for x in text.split("\n") if x]
    for v in (_json(folder, "special_tokens_map.json") or {}).values():
        out += [c for x in (v if isinstance(v, list) else [v]) if isinstance(c := _content(x), str)]
    return list(dict.fromkeys(out))


def split_pattern(folder: str) -> str | None:
    """The split pattern of special_config.json or of tokenizer.json's pre-tokenizer, spelt without look-ahead."""
    own = (_json(folder, "special_config.json") or {}).get("split_regex")
    if own is None:
        steps = (_json(folder, "tokenizer.json") or {}).get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers") or [steps]
        own = next((s["pattern"].get("Regex") for s in steps if s.get("type") == "Split" and isinstance(s.get("pattern"), dict)), None)
    return None if own is None else without_look_ahead(own)


def without_look_ahead(pattern: str) -> str:
    """A split pattern in the portable spelling: the branch for space before a word is dropped, and ``\\s`` is spelt out."""
    pattern = pattern.replace(r"\s+(?!\S)|", "").replace(r"\s+(\S){0}|", "")
    pattern = re.sub(r"(?<=\[\^)\\s|(?<=\[)\\s", lambda _m: r"\t\n\f\r ", pattern)
    return re.sub(r"\\s(?![^\[]*\])", lambda _m: r"[\t\n\f\r ]", pattern)


def processing_steps(folder: str) -> dict[str, list[str]]:
    """The types of the steps tokenizer.json names for normalizer, pre-tokenizer, post-processor and decoder."""
    whole = _json(folder, "tokenizer.json") or {}
    lists = {"normalizer": "normalizers", "pre_tokenizer": "pretokenizers", "post_processor": "processors", "decoder": "decoders"}
    return {k: [s.get("type") for s in (whole[k].get(inner) or [whole[k]])] for k, inner in lists.items() if whole.get(k)}


def load_folder(folder: str, name: str | None = None, skip_header: bool | None = None) -> TokenizerSpec:
    """The tokenizer of a folder, from whatever of the formats it holds."""
    held = settings(folder)
    vocab = read_vocab(folder)
    own = _json(folder, "special_config.json") or {}
    specials = [s for s in special_tokens(folder) + list(held.added) if s in vocab]
    fallback = "0x00" in vocab
    wide_default = held.ignore_merges and len(vocab) > 65_536
    return load(
        name or os.path.basename(folder.rstrip("/")), vocab, read_ranked_merges(folder, skip_header),
        specials=tuple(dict.fromkeys(specials)), pattern=split_pattern(folder) or PATTERN, byte_level=not fallback,
        normalizer=own.get("normalizer") or {}, lower_case=bool(own.get("lower_case", False)), prefix_space=bool(own.get("prefix_space", True)),
        end_of_word=own.get("end_of_word") or "", punctuation=tuple(own.get("punc_runes") or ()), ignore_merges=held.ignore_merges,
        newline_separator=held.newline_mode == "s", bos=held.bos, eos=held.eos, pad=held.pad,
        add_bos=held.add_bos or bool(own.get("enclose_eos_bos")) or wide_default, add_eos=held.add_eos or bool(own.get("enclose_eos_bos")) or wide_default,
    )


def shard_count(index_json: str) -> int:
    """Number of files a sharded model's index names, by the file of its output layer; 0 if it says none.

    >>> shard_count('{"weight_map": {"lm_head.weight": "model-00002-of-00003.bin"}}')
    3
    """
    names = (json.loads(index_json).get("weight_map")) or {}
    for layer in ("embed_out.weight", "lm_head.weight"):
        if (m := re.search(r"\D*\d+\D+(\d+)", names.get(layer, ""))) is not None:
            return int(m[1])
    return 0


def missing_files(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of (file, size) that are wanted and not held with the same size; a null size is held by any."""
    same = (wanted.file == held.file) & (wanted.size.isNull() | (wanted.size == held.size))
    return wanted.join(held, same, "left_anti")


def vocab_rows(json_text: str | Column = "value") -> Column:
    """Entries of a vocab.json text as array<struct<key, value>>, to explode."""
    return F.map_entries(F.from_json(json_text, "map<string,bigint>"))

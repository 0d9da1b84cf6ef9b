"""The corpus pipeline: language ID, quality rules, near duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All stages but
the last return the columns of documents; rejected documents are gone, copies but one are gone,
personal data is generalised in the text. Empty and null texts are rejected by the first stage.
"""

from __future__ import annotations

from docsheaf.llm import lang_id, near_dup, packing, pii, quality_rules
from docsheaf.llm.common import read, table


def _prefix(docs):
    """Underscores that no column starts with, for the names that an operator adds."""
    out = "__"
    while any(c.startswith(out) for c in docs.columns):
        out += "_"
    return out


def language_id(spark, docs, sf_dir):
    own = _prefix(docs)
    found = lang_id.identify(docs, lang_id.train(docs), extra=tuple(docs.columns), prefix=own)
    return found.where(f"{own}kept").select(*docs.columns)


def quality(spark, docs, sf_dir):
    rules, own = quality_rules.train(docs, read(spark, sf_dir, "labels")), _prefix(docs)
    return quality_rules.judge(docs, rules, extra=tuple(docs.columns), prefix=own).where(f"{own}kept").select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    return near_dup.representatives(docs)


def personal_data(spark, docs, sf_dir):
    return pii.sanitise(docs)


def packed(spark, docs, sf_dir):
    import public_tokenizers as public

    return packing.pack_documents(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


STAGES = [("language_id", language_id), ("quality_rules", quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("packing", packed)]

#: trained models, alignment and tokenization are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs

"""Residue alphabets and the token vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from residuum.functions.digests import in_slices, pieces, text_parts

# The 20 standard amino acids, in this order.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# The public 33-token ESM-2 vocabulary, listed by token id
# 0..32 (special tokens first, then residues by frequency, then extras).
ESM_TOKENS = [
    "<cls>", "<pad>", "<eos>", "<unk>",
    "L", "A", "G", "V", "S", "E", "R", "T", "I", "D", "P", "K", "Q", "N",
    "F", "Y", "M", "H", "W", "C", "X", "B", "U", "Z", "O", ".", "-",
    "<null_1>", "<mask>",
]
CLS_ID = ESM_TOKENS.index("<cls>")
PAD_ID = ESM_TOKENS.index("<pad>")
EOS_ID = ESM_TOKENS.index("<eos>")
UNK_ID = ESM_TOKENS.index("<unk>")
MASK_ID = ESM_TOKENS.index("<mask>")
IGNORE_LABEL = -100

# Token ids of the 20 standard residues, in AMINO_ACIDS order.
AA_TOKEN_IDS = [ESM_TOKENS.index(a) for a in AMINO_ACIDS]


def residue_only(text: Column) -> Column:
    """Keep residue letters (either case), then uppercase.

    Stripping happens before ``upper`` on purpose: uppercasing first would
    turn some non-ASCII letters into ASCII residues.
    """
    pattern = f"[^{AMINO_ACIDS}{AMINO_ACIDS.lower()}]"
    return F.upper(F.regexp_replace(text, pattern, ""))


# upper-case letter of every byte, and the bytes that are no residue; a letter of several
# bytes has none
_UPPER = bytes(range(256)).upper()
_OTHER = bytes(i for i in range(256) if chr(i) not in AMINO_ACIDS + AMINO_ACIDS.lower())


def residue_letters(text: Column) -> Column:
    """``residue_only`` on Arrow batches, for queries that go on in Python."""

    @F.arrow_udf("string")
    @in_slices
    def _strip(texts: pa.Array) -> pa.Array:
        offsets, data = text_parts(texts)
        whole, at = data.tobytes(), offsets.tolist()
        rows = [whole[i:j].translate(_UPPER, _OTHER) for i, j in zip(at, at[1:])]
        ends = np.cumsum([0, *map(len, rows)])
        return pieces(texts, ends, np.frombuffer(b"".join(rows), dtype=np.uint8), pa.string())

    return _strip(text)


def vocab_map() -> Column:
    """Literal MAP<STRING, INT> from single-character tokens to ids."""
    kv = []
    for i, t in enumerate(ESM_TOKENS):
        if len(t) == 1:
            kv += [F.lit(t), F.lit(i)]
    return F.create_map(*kv)


def aa_array() -> Column:
    """Literal ARRAY<STRING> of the 20 residues."""
    return F.array(*[F.lit(a) for a in AMINO_ACIDS])

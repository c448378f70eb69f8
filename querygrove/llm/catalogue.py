"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import hosts, language, mixing, neardup, neighbours, packing, private, quality, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_systematic_mix": mixing.op2_systematic_mix,
    "op3_recurrent_toxicity": toxicity.op3_recurrent_toxicity,
    "op4_ffd_packing": packing.op4_ffd_packing,
    "op5_string_kernel_language": language.op5_string_kernel_language,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_surrogates": private.op7_surrogates,
    "op8_superminhash": neardup.op8_superminhash,
    "op9_nn_descent": neighbours.op9_nn_descent,
    "op10_host_reputation": hosts.op10_host_reputation,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op2_systematic_mix": mixing.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op8_superminhash": neardup.ORACLE,
    "op10_host_reputation": hosts.ORACLE,
}

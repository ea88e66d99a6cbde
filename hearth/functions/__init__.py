from hearth.functions.exprs import (LOG_LOSS_EPS, bin_right_closed, clip_prob,
                                   hash_hex, hex_prefix_int, is_numeric,
                                   log_loss_term, logistic, prob_of_class,
                                   safe_ln, stringify)

__all__ = [
    "LOG_LOSS_EPS", "bin_right_closed", "clip_prob", "hash_hex", "hex_prefix_int",
    "is_numeric", "log_loss_term", "logistic", "prob_of_class", "safe_ln", "stringify",
]

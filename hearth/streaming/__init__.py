from hearth.streaming.score import read_household_stream, score_stream, write_scores

__all__ = ["read_household_stream", "score_stream", "write_scores"]

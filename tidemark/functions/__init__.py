from .numeric import exact_mean, money_sum, pct, round_half_up, to_double
from .text import contains_any, fence_body, head, md5_id
from .vectors import cosine_distance, cosine_similarity, dot, norm, similarity_from_distance

__all__ = [
    "exact_mean", "money_sum", "pct", "round_half_up", "to_double",
    "contains_any", "fence_body", "head", "md5_id",
    "cosine_distance", "cosine_similarity", "dot", "norm", "similarity_from_distance",
]

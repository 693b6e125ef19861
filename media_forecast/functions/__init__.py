from .columns import (  # noqa: F401
    CAMPAIGN_TYPE_DEFAULT,
    CAMPAIGN_TYPE_RULES,
    MISSING_TOKENS,
    campaign_type_from_name,
    clean_text,
    exact,
    exact_sum,
    exact_sum_nullable,
    nan_to_null,
    number,
    out_round,
    safe_ratio,
    shortest_number,
    week_start,
)

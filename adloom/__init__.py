"""adloom: daily advertising analytics written as Spark DataFrame operators.

Raw impression, click, conversion and cost logs are landed with fixed types, cleaned, deduplicated and enriched,
rolled up per campaign, advertiser and user, turned into user tags and reports, and checked by a quality gate.
Every operator is a function from DataFrames to a DataFrame; nothing runs until the caller asks for an action.
"""

"""samplequote: survey-sample price quoting on Spark DataFrames.

Main entry points:
  plans.quote.prepare_lookups, plans.quote.quote      batch quoting
  streaming.stream.quote_stream                      streaming quoting
  operators.flatten.flatten_request                  nested requests -> rows
  params.QuoteParams                                 options and constants
"""

from .params import DEFAULT_PARAMS, QuoteParams

__all__ = ["DEFAULT_PARAMS", "QuoteParams"]

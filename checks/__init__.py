"""The registered queries: each runs an operator over whole tables, next to SQL that gives the
same rows where SQL can."""

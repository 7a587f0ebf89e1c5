"""The catalogue of queries and their SQL."""

from segloom.plans import files, graphs, groups, inference, more, problems, records, rules, sampling, text, timeline

QUERIES = {**timeline.QUERIES, **groups.QUERIES, **inference.QUERIES, **sampling.QUERIES, **records.QUERIES, **text.QUERIES, **graphs.QUERIES, **more.QUERIES, **rules.QUERIES, **files.QUERIES, **problems.QUERIES}
ORACLE = {**timeline.ORACLE, **groups.ORACLE, **inference.ORACLE, **sampling.ORACLE, **records.ORACLE, **text.ORACLE, **graphs.ORACLE, **more.ORACLE, **rules.ORACLE, **files.ORACLE, **problems.ORACLE}
FLAGSHIP = "seg_positional_eval"

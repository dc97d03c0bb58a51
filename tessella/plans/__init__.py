"""Builders: each step gives a new query; ``to_df`` lowers it to one DataFrame, actions run it."""

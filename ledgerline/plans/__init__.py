"""The workflows: operators put together, with their outputs."""

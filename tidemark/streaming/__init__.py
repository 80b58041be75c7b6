"""The reference works on static tables only; there is no streaming operator to build."""

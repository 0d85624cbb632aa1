"""Text that the tests of this folder share."""

LOREM = "the committee met on monday to discuss the budget for roads bridges and schools and after a long debate agreed that every district should first publish what it spends each year before asking for more money from the common fund which had been growing slowly since the reform"

"""spark-submit entry for the page refresh job (see ledgerlens.plans.report)."""

from ledgerlens.plans.report import main

if __name__ == "__main__":
    main()
